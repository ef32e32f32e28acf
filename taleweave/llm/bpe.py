"""Byte-level BPE by a lexicon: frequent words through an automaton, unseen words by exact merging.

Method: frequent words of the corpus and their ids are compiled into a minimal acyclic transducer: words share suffixes as
well as prefixes, each edge carries how many words sort before it, and the sum along a word's path is its number, under which
its ids stand. The automaton is one file that tasks memory-map. All words of a slice of texts walk it together, a byte of
each at a step. Words that it hasn't are merged exactly, once per slice.

Texts are cut into words as the vocabulary's own pattern does (contractions, a space before letters, digits or signs, runs of
white space), over arrays of character classes. A text with the vocabulary's special string, or with a character that
this Python's Unicode tables don't know, is encoded by the tokenizers library itself.

Scale: counting words aggregates in each task before its shuffle, over all texts; only the most frequent, LEXICON_WORDS
at most, reach the driver. Encoding and decoding are maps over rows. Memory: one slice of texts.

Defined cases: null text is the empty text: no ids, and the digests of empty strings. Repeated rows give repeated results. An
empty table has an empty lexicon and result. Words of equal counts are all in the lexicon or all out. Other columns are not
read.
"""

import atexit
import hashlib
import os
import shutil
import tempfile
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import rows_to_batch, small_batches, span_hashes, text_slices
from taleweave.llm.lineage import stored

#: Words compiled into the lexicon; the file takes about 200 bytes a word.
LEXICON_WORDS = 50_000
#: Longer words are rare and not counted for the lexicon.
LONGEST = 40
#: Entries that a task's counts of words may have before they are sent on.
STORE = 400_000

#: Set between words that are merged together; the pattern would cut a word before "mark".
_MARK = b"<|mark|>"

# The pattern's classes and contractions.
_LETTER, _NUMBER, _WHITE, _SIGN, _UNKNOWN = 0, 1, 2, 3, 4
_WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SHORT, _LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


#: Texts are encoded in slices of about this many bytes, each of which takes a few hundred bytes of arrays meanwhile.
ENCODED_BYTES = 1 << 18


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([_UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _SIGN) for i in range(0x110000)], dtype=np.uint8)
    table[list(_WHITE_SPACE)] = _WHITE
    return table


def cut_words(rows: list[str]):
    """(data, first, last, bounds): UTF-8 bytes of all rows, the byte spans of their words, and each row's first word; rows must have known characters."""
    text = "".join(rows)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    n = len(points)
    row_ends = np.cumsum([len(r) for r in rows])
    row_starts = np.concatenate(([0], row_ends[:-1])).astype(np.int64)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return data, none, none, np.zeros(len(rows) + 1, dtype=np.int64)
    kind = _classes()[points]
    opens = np.zeros(n + 1, dtype=bool)  # at which character a row begins; one more for the end
    opens[row_starts] = True
    opens[n] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(run)
    end = np.append(start[1:], n)
    white = kind[start] == _WHITE
    followed = ~opens[end]  # by another run of the same row
    size = end - start
    tail_space = white & followed & (points[end - 1] == 32)  # this space joins the next run
    begins = np.zeros(n + 1, dtype=bool)
    joins_before = np.zeros(len(start), dtype=bool)
    joins_before[1:] = tail_space[:-1]  # a row's first run never follows one of its row
    begins[start[~joins_before]] = True
    begins[end[white & followed & (size > 1)] - 1] = True  # the last white character stands alone or joins
    begins[start[tail_space & (size == 1)]] = True
    # An apostrophe alone before letters, not joined to a space: a contraction.
    quote = np.flatnonzero((points[start] == 39) & (size == 1) & ~joins_before & followed & (kind[start] == _SIGN))
    quote = quote[kind[start[quote] + 1] == _LETTER]
    if len(quote):
        at = start[quote] + 1
        letters = end[quote + 1] - at
        one, two = points[at], points[np.minimum(at + 1, n - 1)]
        taken = np.zeros(len(at), dtype=np.int64)
        for c in _SHORT:
            taken[one == ord(c)] = 1
        for a, b in _LONG:
            taken[(one == ord(a)) & (two == ord(b)) & (letters > 1)] = 2
        at, letters, taken = at[taken > 0], letters[taken > 0], taken[taken > 0]
        begins[at] = False
        begins[(at + taken)[letters > taken]] = True
    begins[n] = True
    at = np.flatnonzero(begins)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) if len(data) > n else None
    place = np.concatenate(([0], np.cumsum(width)))[at] if width is not None else at
    bounds = np.append(np.searchsorted(at, row_starts), len(at) - 1)
    return data, place[:-1], place[1:], bounds


def plain(row: str, special: str) -> bool:
    """Whether cut_words knows all of the row and no special string is in it."""
    if special and special in row:
        return False
    if row.isascii():
        return True
    kinds = _classes()
    return all(kinds[ord(c)] != _UNKNOWN for c in set(row))


class Automaton:
    """Numbers of the words of a lexicon, and their ids, over one memory-mapped array."""

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> np.ndarray:
        """The minimal automaton of the words as one array of integers."""
        ordered = sorted(words)
        alphabet = sorted({b for w in ordered for b in w})
        code = {b: i + 1 for i, b in enumerate(alphabet)}
        frozen: dict = {}
        states: list[tuple[bool, tuple]] = [(False, ())]  # 0: the dead state
        reach = [0]

        def freeze(final, edges):
            key = (final, tuple(edges))
            if key not in frozen:
                frozen[key] = len(states)
                states.append(key)
                reach.append(final + sum(reach[s] for _, s in edges))
            return frozen[key]

        path: list[list] = [[False, [], 0]]  # of the last word: final, edges that are frozen, byte that led here
        last = b""
        for word in [*ordered, None]:
            same = 0
            if word is not None:
                while same < min(len(word), len(last)) and word[same] == last[same]:
                    same += 1
            while len(path) > same + 1 or (word is None and len(path) > 1):
                final, edges, byte = path.pop()
                path[-1][1].append((code[byte], freeze(final, edges)))
            if word is None:
                break
            path += [[False, [], b] for b in word[same:]]
            path[-1][0] = True
            last = word
        root = freeze(path[0][0], path[0][1])
        width = len(alphabet) + 1
        table = np.zeros((len(states), width), dtype=np.int64)
        for s, (final, edges) in enumerate(states):
            before = int(final)
            for c, to in edges:
                table[s, c] = to << 32 | before
                before += reach[to]
        to_code = np.zeros(256, dtype=np.int64)
        to_code[alphabet] = np.arange(1, width)
        counts = [len(words[w]) for w in ordered]
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        ids = np.array([i for w in ordered for i in words[w]], dtype=np.int64)
        final = np.array([f for f, _ in states], dtype=np.int64)
        return np.concatenate(([len(states), width, root, len(ordered), len(ids)], to_code, final, offsets, ids, table.ravel())).astype(np.int64)

    def __init__(self, array: np.ndarray):
        n, width, self.root, words, ids = (int(x) for x in array[:5])
        cuts = np.cumsum([5, 256, n, words + 1, ids, n * width])
        self.code, self.final, self.offsets, self.ids, table = (array[a:b] for a, b in zip(cuts, cuts[1:]))
        self.table, self.width = table, width

    def numbers(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The number of each word data[first:last], -1 for those that the lexicon hasn't."""
        found = np.full(len(first), -1, dtype=np.int64)
        codes = self.code[data]
        live, state, number, at = np.arange(len(first)), np.full(len(first), self.root, dtype=np.int64), np.zeros(len(first), dtype=np.int64), first.copy()
        ends = last
        while len(live):
            edge = self.table[state * self.width + codes[at]]
            state = edge >> 32
            number = number + (edge & 0xFFFFFFFF)
            at = at + 1
            over = at == ends
            stop = over & (state > 0)
            stop[stop] = self.final[state[stop]] == 1
            found[live[stop]] = number[stop]
            going = ~over & (state > 0)
            live, state, number, at, ends = live[going], state[going], number[going], at[going], ends[going]
        return found


class Encoder:
    """Ids of texts, equal to those of the tokenizers library without added special tokens."""

    def __init__(self, vocabulary: str, lexicon: np.ndarray | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder()
        self.special = next((t.content for t in added.values()), "")
        self.pieces = _piece_bytes(vocabulary)
        self.merger = _merger(vocabulary)
        self.automaton = Automaton(_vocabulary_lexicon(vocabulary) if lexicon is None else lexicon)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words, how many each has), by exact merging in one call: no word holds the mark set between them."""
        flat = self.merger.encode_to_numpy(_MARK.join(words).decode("utf-8"), allowed_special="all").astype(np.int64)
        marks = np.flatnonzero(flat == self.merger.max_token_value)
        return np.delete(flat, marks), np.diff(np.concatenate(([-1], marks, [len(flat)]))) - 1

    def _ids(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's first) for rows of plain text."""
        data, first, last, bounds = cut_words(rows)
        number = self.automaton.numbers(data, first, last)
        unseen = np.flatnonzero(number < 0)
        offsets, flat = self.automaton.offsets, self.automaton.ids
        if len(unseen):
            # Two hashes tell the words of a slice apart; each distinct one is merged once.
            a, b = span_hashes(data, first[unseen], last[unseen]), span_hashes(data, first[unseen], last[unseen], 1)
            _, one, same = np.unique(a, return_index=True, return_inverse=True)
            if not np.array_equal(b, b[one][same]):
                one = same = np.arange(len(unseen))
            raw = data.tobytes()
            extra, counts = self._merged([raw[x:y] for x, y in zip(first[unseen[one]].tolist(), last[unseen[one]].tolist())])
            number[unseen] = len(offsets) - 1 + same
            offsets = np.concatenate((offsets, offsets[-1] + np.cumsum(counts)))
            flat = np.concatenate((flat, extra))
        source, count = offsets[number], offsets[number + 1] - offsets[number]
        target = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(source - target[:-1], count) + np.arange(target[-1])]
        return ids, target[bounds]

    def encode(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        texts = [r.decode("utf-8", "replace") for r in rows]
        usual = [i for i, t in enumerate(texts) if plain(t, self.special)]
        out: list = [None] * len(rows)
        if usual:
            ids, at = self._ids([texts[i] for i in usual])
            for k, i in enumerate(usual):
                out[i] = ids[at[k] : at[k + 1]]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int64)
        return out

    def decode(self, ids) -> str:
        """The text of ids, as the library's decode with special tokens kept."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _piece_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id; a vocabulary writes bytes as printable characters, and special tokens as they are."""
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    library = Tokenizer.from_file(vocabulary)
    special = library.get_added_tokens_decoder()
    names = library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = name.encode() if i in special else bytes(byte[c] for c in name)
    return out


@lru_cache(maxsize=2)
def _merger(vocabulary: str):
    """Exact merging of single words: ids of a byte-level vocabulary are in the order of its merges."""
    import json

    import tiktoken

    model = json.load(open(vocabulary))
    special = {t["id"] for t in model.get("added_tokens", [])}
    order = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
    made = [model["model"]["vocab"][m] for m in order]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    ranks = {b: i for i, b in enumerate(_piece_bytes(vocabulary)) if i not in special and b}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={_MARK.decode(): len(ranks) + len(special)})


@lru_cache(maxsize=2)
def _vocabulary_lexicon(vocabulary: str) -> np.ndarray:
    """A lexicon of the vocabulary's own words, for use without a corpus."""
    merger, words = _merger(vocabulary), {}
    for piece in _piece_bytes(vocabulary):
        try:
            text = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if 0 < len(piece) <= LONGEST and plain(text, ""):
            words[piece] = merger.encode_ordinary(text)
    return Automaton.compile(words)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) of all texts; the library's rare cases are left out, which only leaves them out of the lexicon."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def out(counts):
        return rows_to_batch(schema, {"word": list(counts), "n": list(counts.values())})

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for _, rows in text_slices(batch, limit=ENCODED_BYTES):
                data, first, last, _ = cut_words([t for r in rows if plain(t := r.decode("utf-8", "replace"), "")])
                short = last - first <= LONGEST
                first, last = first[short], last[short]
                _, one, times = np.unique(span_hashes(data, first, last), return_index=True, return_counts=True)
                raw = data.tobytes()
                for i, n in zip(one.tolist(), times.tolist()):
                    word = raw[first[i] : last[i]]
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= STORE:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    return small_batches(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, words: int) -> list[bytes]:
    """At most `words` words, the most frequent ones: those in the highest sixteenths of an octave of counts that fit."""
    held = stored(word_counts(docs).where("n > 1").withColumn("level", F.floor(16 * F.log2("n")).cast("int")))
    levels = sorted(((r["level"], r["words"]) for r in held.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True)  # under 1,100 rows
    total, least = 0, None
    for level, n in levels:
        if total + n > words:
            break
        total, least = total + n, level
    if least is None:
        return []
    return [bytes(r["word"]) for r in held.where(F.col("level") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> np.ndarray:
    """The automaton of the corpus's most frequent words."""
    merger = _merger(vocabulary)
    return Automaton.compile({w: merger.encode_ordinary(w.decode("utf-8")) for w in frequent_words(docs, words)})


def ship(spark, lexicon: np.ndarray) -> str:
    """The name under which tasks find the lexicon's file."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))  # the driver's file server reads it whenever an executor asks
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    np.save(os.path.join(folder, name), lexicon)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


@lru_cache(maxsize=4)
def task_encoder(vocabulary: str, name: str | None) -> Encoder:
    """One encoder per worker, over the memory-mapped lexicon; without one, over the vocabulary's words."""
    return Encoder(vocabulary, np.load(SparkFiles.get(name), mmap_mode="r") if name else None)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, vocabulary: str, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids array) of each document: the operator's real output."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = task_encoder(vocabulary, lexicon)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch, limit=ENCODED_BYTES):
                yield rows_to_batch(schema, {"doc_id": ids.slice(first, len(rows)), "ids": [x.astype(np.int32) for x in encoder.encode(rows)]})

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encoding_digests(docs: DataFrame, vocabulary: str, lexicon: str | None = None) -> DataFrame:
    """n_tokens, and digests of the ids and of the text decoded from them, of each document; ids stay in the task."""

    def run(batches):
        encoder = task_encoder(vocabulary, lexicon)
        decimal = [str(i) for i in range(len(encoder.pieces))]
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, rows in text_slices(batch, limit=ENCODED_BYTES):
                encoded = [x.tolist() for x in encoder.encode(rows)]
                yield rows_to_batch(ENCODED, {
                    "doc_id": doc_ids.slice(first, len(rows)), "n_tokens": [len(x) for x in encoded],
                    "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in encoded],
                    "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in encoded],
                })

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
