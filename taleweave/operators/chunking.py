"""Sentences and bounded chunks of paragraphs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.speech import fingerprint, trimmed
from taleweave.operators.folding import bound, fold

# Words whose period ends no sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "rev", "fr", "sr", "jr", "st", "hon", "vs", "etc", "eg", "ie", "cf", "no", "vol",
    "vols", "ch", "chap", "chaps", "pp", "fig", "figs", "approx", "est", "dept", "univ", "co", "inc", "ltd", "ed", "eds",
    "trans", "ibid", "al", "am", "pm", "ad", "bc", "ca", "circa", "gen", "ex", "exod", "lev", "num", "deut", "josh", "judg",
    "sam", "kgs", "kings", "chron", "ezra", "neh", "esth", "ps", "pss", "prov", "eccl", "song", "isa", "jer", "lam", "ezek",
    "dan", "hos", "obad", "mic", "nah", "hab", "zeph", "hag", "zech", "mal", "matt", "mk", "lk", "jn", "rom", "cor", "gal",
    "eph", "phil", "col", "thess", "tim", "titus", "phlm", "heb", "jas", "pet", "jude",
)
# What a list marker at the start of a sentence looks like.
LIST_MARKER = r"^[\(\[]?(?:[0-9]{1,3}|[ivxlIVXL]{1,5})[\)\].]{1,2}$"

MAX_CHARS = 300
#: Set between pieces: a code point that is no character, so that no text has it.
CUT = "\ufdd0"
#: What stands for that code point while a text is split, if it has it.
_ELSE = "\ufdd1"


def paragraphs(docs: DataFrame, text: str = "text", break_at: str = "\n\n") -> DataFrame:
    """The rows with para_no and paragraph, one per paragraph; line feeds inside become spaces, empty paragraphs keep their number."""
    inner = trimmed(F.replace("paragraph", F.lit("\n"), F.lit(" ")))
    return docs.select("*", F.posexplode(F.split(text, break_at)).alias("para_no", "paragraph")).drop(text).withColumn("paragraph", inner)


def sentence_pieces(paragraph: Column) -> Column:
    """text, break, text, break, ..., text: a paragraph split at all places where a sentence may end."""
    free = F.when(F.contains(paragraph, F.lit(CUT)), F.translate(paragraph, CUT, _ELSE)).otherwise(paragraph)
    marked = F.regexp_replace(free, r"""(?U)([.!?])(["'”’)]*\s+)""", f"$1{CUT}$2{CUT}")
    return F.split(marked, CUT)


#: What a possible break is: the end of a sentence, none, or none if what stands before it begins a sentence.
_ENDS, _STAYS, _MARKS = 0, 1, 2


def break_kind(head: Column, following: Column) -> Column:
    """The kind of the break after a piece. A period ends no sentence before lower case, after an initial or an abbreviation, and after a list marker that begins one."""
    word = F.lower(F.regexp_replace(F.regexp_extract(F.right(F.substring_index(head, " ", -1), F.lit(80)), r"([A-Za-z](?:[A-Za-z.]*[A-Za-z])?)\.$", 1), r"\.", ""))
    short = bound(word, lambda w: (F.length(w) == 1) | w.isin(*ABBREVIATIONS))
    marker = (F.length(head) < 40) & trimmed(head).rlike(LIST_MARKER)
    kind = F.when(following.rlike(r"^\p{javaLowerCase}"), _STAYS).when(short, _STAYS).when(marker, _MARKS).otherwise(_ENDS)
    return F.when(F.endswith(head, F.lit(".")), kind).otherwise(_ENDS)


def false_break(head: Column, following: Column) -> Column:
    """Whether a piece, at the beginning of a sentence, ends none."""
    return break_kind(head, following) != _ENDS


def sentences(paragraph: Column, each_marker: bool = False) -> Column:
    """Sentences after . ! ? and white space; closing quotes at a break are lost with it, at a false break they stay.

    Breaks are judged each by itself, then the pieces are joined with a mark at the true ones and split there: no array or text grows
    step by step. Only list markers in a row, of which the first is one, are gone through in order. A U+FDD0 in the text comes back as it was.
    each_marker: a list marker ends no sentence wherever it stands between two possible breaks (as in the queries' SQL), not only where it begins one (as in the reference).
    """

    def settled(kinds):
        def step(last, kind):
            now = F.when(kind == _MARKS, F.when(last == _STAYS, _ENDS).otherwise(_STAYS)).otherwise(kind)
            return now, F.lit(True), now

        return F.when(F.array_contains(kinds, _MARKS), fold(kinds, F.lit(_ENDS), step, "int")["out"]).otherwise(kinds)

    def split(pieces):
        places = F.sequence(F.lit(0), ((F.size(pieces) - 3) / 2).cast("int"))
        kinds = F.transform(places, lambda k: break_kind(F.get(pieces, 2 * k), F.get(pieces, 2 * k + 2)))
        shown = lambda kinds: F.transform(pieces, lambda piece, i: F.when((i % 2 == 1) & (F.get(kinds, ((i - 1) / 2).cast("int")) == _ENDS), CUT).otherwise(piece))
        joined = bound(kinds if each_marker else settled(kinds), lambda kinds: F.array_join(shown(kinds), ""))
        return F.when(F.size(pieces) > 1, F.split(joined, CUT)).otherwise(pieces)

    found = F.filter(F.transform(bound(sentence_pieces(paragraph), split), trimmed), lambda x: x != "")
    return F.when(F.contains(paragraph, F.lit(CUT)), F.transform(found, lambda x: F.translate(x, _ELSE, CUT))).otherwise(found)


#: An over-long sentence is read in windows of this many times the longest piece.
_WINDOW = 32


def fit(sentence: Column, most: int = MAX_CHARS) -> Column:
    """An over-long sentence in pieces: cut after the last comma (unless it is in the first half), else the last space, else hard.

    The sentence is read window by window; what is left of one, at most a piece, goes before the next. So the time is linear in its length.
    """
    last = lambda head, c: F.when(F.instr(head, c) > 0, most - F.instr(head, c)).otherwise(-1)  # noqa: E731  counted from 0
    left_trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")

    def cut(rest, _):
        def cut_at(place):
            return F.struct(left_trimmed(F.substring(rest, place + 2, F.length(rest))).alias("rest"), trimmed(F.substring(rest, F.lit(1), place + 1)).alias("piece"))

        place = bound(F.reverse(F.substring(rest, 1, most)), lambda head: F.when(last(head, ",") >= most // 2, last(head, ",")).when(last(head, " ") > 0, last(head, " ")).otherwise(most))
        return bound(place, cut_at)

    def pieces_of(text):
        def step(acc, _):
            done = bound(cut(acc["rest"], _), lambda c: F.struct(c["rest"].alias("rest"), F.concat(acc["out"], F.array(c["piece"])).alias("out")))
            return F.when(F.length(acc["rest"]) > most, done).otherwise(acc)

        # Two cuts in a row use up at least `most` characters: behind a cut at the last space there is none up to where the window ended.
        cuts = 2 * F.ceil(F.length(text) / most).cast("int") + 2
        return F.aggregate(F.sequence(F.lit(1), cuts), F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out")), step)

    def window(rest, part):
        text = F.when(rest == "", left_trimmed(part)).otherwise(F.concat(rest, part))
        made = bound(text, pieces_of)
        return made["rest"], F.lit(True), made["out"]

    def long_one(text):
        windows = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_WINDOW * most}}}"), 0)
        whole = fold(windows, F.lit(""), window, "array<string>")
        return bound(whole, lambda w: F.flatten(F.when(w["state"] != "", F.concat(w["out"], F.array(F.array(w["state"])))).otherwise(w["out"])))

    return F.when(F.length(sentence) > most, long_one(F.regexp_replace(sentence, r"(?U)\s+$", ""))).otherwise(F.array(sentence))


def pack(pieces: Column, most: int = MAX_CHARS) -> Column:
    """Pieces joined by spaces into chunks of at most `most` characters."""

    def step(open_, piece):
        over = (open_ != "") & (F.length(open_) + F.length(piece) + 1 > most)
        return F.when(over | (open_ == ""), piece).otherwise(F.concat(open_, F.lit(" "), piece)), over, open_

    return bound(fold(pieces, F.lit(""), step, "string"), lambda f: F.when(f["state"] != "", F.concat(f["out"], F.array(f["state"]))).otherwise(f["out"]))


def chunk_paragraphs(paras: DataFrame, most: int = MAX_CHARS, each_marker: bool = False) -> DataFrame:
    """paragraph replaced by sentences and chunks (arrays)."""
    held = paras.withColumn("sentences", sentences(F.col("paragraph"), each_marker))
    return held.withColumn("chunks", pack(F.flatten(F.transform("sentences", lambda s: fit(s, most))), most)).drop("paragraph")


def flat_chunks(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chunk, with chunk_no counted over a document's paragraphs."""
    order = Window.partitionBy(*keys).orderBy("para_no", "_n")
    flat = chunked.select(*keys, "para_no", F.posexplode("chunks").alias("_n", "chunk"))
    return flat.withColumn("chunk_no", F.row_number().over(order) - 1).drop("_n")


def document_chunks(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: chunks, their characters and their fingerprint."""
    parts = chunked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("para_no", "chunks"))).alias("p"))
    every = F.flatten(F.transform("p", lambda p: p["chunks"]))
    return parts.select(*keys, every.alias("chunks")).select(
        *keys, F.size("chunks").cast("long").alias("n_chunks"), F.greatest(F.lit(1), F.aggregate("chunks", F.lit(0), lambda a, c: a + F.length(c))).cast("long").alias("chars"), fingerprint(F.col("chunks")).alias("fingerprint")
    )
