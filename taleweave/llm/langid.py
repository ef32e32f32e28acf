"""Language of a text by how well each language's dictionary compresses it.

Method: for each language a raw-content zstandard dictionary is cut from labelled texts. A text is compressed with each
dictionary, in blocks of BLOCK bytes so that the dictionary is in reach all along; the language with the smallest total is
chosen. The margin is how much larger the second total is; a margin below MARGIN rejects the text.

Fitting reads a bounded sample, SAMPLE_BYTES of text per language (a documented bound; dictionaries need no more): the
documents with the smallest hash of their id, found by a top-k per language that Spark prunes before its shuffle.
Prediction is a map over all rows: no shuffle, memory for a few blocks and one dictionary per language.

Defined cases: null text and text without a letter are `und`, score 0, rejected. With no labelled text at all every text is
`und`. One learned language is always chosen, score 1. Ties go to the language first in the alphabet. Texts are read whole.
Null lang rows are never learned from. Repeated rows are learned from and predicted each. An empty table gives no dictionary and an
empty result. Other columns of the input are not read.
"""

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import rows_to_batch, small_batches, text_slices

UND = "und"
#: Bytes of text per language in its dictionary, and documents per language that the sample may hold.
SAMPLE_BYTES = 32 << 10
SAMPLE_DOCS = 200
#: Bytes compressed at a time.
BLOCK = 16 << 10
#: A second best total less than this share above the best makes the choice too narrow to keep.
MARGIN = 0.005
#: zstandard level; matches of three bytes count, since most texts are short.
LEVEL, MIN_MATCH = 5, 3
#: What is compressed: words in lower case. Case, digits and signs tell no language.
_NOT_WORD = re.compile(r"[^\w]+|[\d_]+")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_()),
])


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: non-null lang and text, and crc32 of the id as text not 1 modulo 3."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> dict[str, bytes]:
    """A raw dictionary per language, from SAMPLE_BYTES of its labelled texts."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    each = SAMPLE_BYTES // 20
    sample = labelled(docs).select("doc_id", "lang", F.substring("text", 1, each).alias("text")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCS)
    texts: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "nth").select("lang", "text").collect():  # at most SAMPLE_DOCS short texts a language
        texts.setdefault(row["lang"], []).append(words_only(row["text"]))
    return {lang: b" ".join(rows)[:SAMPLE_BYTES] for lang, rows in sorted(texts.items()) if any(rows)}


def words_only(text: str) -> bytes:
    return " ".join(_NOT_WORD.sub(" ", text.lower()).split()).encode("utf-8", "surrogatepass")


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return any(c in text for c in _LETTERS) if len(text) < 64 else text.translate(None, _LETTERS) != text
    return any(unicodedata.category(c)[0] == "L" for c in dict.fromkeys(text.decode("utf-8", "replace")))


_LETTERS = bytes([*range(65, 91), *range(97, 123)])


class Classifier:
    """Compressors of the learned languages; one per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
            raw.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: bytes) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected); score is the margin scaled to 0..1."""
        if not self.langs or not has_letter(text):
            return UND, 0.0, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0, False
        sizes = self.sizes(words_only(text.decode("utf-8", "replace")))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = sizes[order[1]] / sizes[order[0]] - 1
        return self.langs[order[0]], min(1.0, margin / (margin + 0.05)), margin, margin < MARGIN


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each document; nothing but its text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # SAMPLE_BYTES a language

    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch):
                lang, score, margin, rejected = zip(*map(model.predict, rows))
                yield rows_to_batch(SCHEMA, {"doc_id": ids.slice(first, len(rows)), "lang_pred": lang, "score": score, "margin": margin, "rejected": rejected})

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with a sufficient margin, with all their columns."""
    dictionaries = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            for first, rows in text_slices(batch):
                yield batch.slice(first, len(rows)).filter(pa.array([not model.predict(r)[3] for r in rows], type=pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
