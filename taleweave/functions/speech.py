"""Column functions that prepare text to be read aloud. All are built-in expressions; null stays null."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what is read. Java's classes are Unicode with (?U).
PAGE_NUMBER = r"(?U)^\s*[-–—\[\(]*\s*\d{1,4}\s*[-–—\]\)]*\s*$"
NOTE_MARK = r"(?U)\[\s*(?:note\s*)?\d{1,3}\s*\]"
LINE_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\u0085\u2028\u2029"
CITATION = (
    r"\s*(?:(?:see\s+|cf\.?\s*|ibid\.?|e\.g\.?|i\.e\.?|vol\.?|chap\.?|pp?\.|vv?\.)"
    r"|(?:\d+\s*[:.]\s*\d+)|(?:[1-3]?\s*[A-Z][a-z]{1,5}\.?\s*\d)|(?:AD|BC|c\.|ca\.)?\s*\d{1,4}(?:[–-]\d{1,4})?)"
)
PARENTHETICAL = r"\([^()]{1,90}\)"
CITED = rf"(?U)\((?=[^()]{{1,90}}\)){CITATION}[^()]*\)"
FRONT_MATTER = (
    r"(?i)^\s*(?:(?:table of )?contents\b|(?:cover|copyright|colophon|title page|half title|index|dedication|acknowledge?ments?"
    r"|about the (?:author|publisher)|imprint|advertisement|also by|praise for|front ?matter|back ?matter)\b)"
)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end. The ends are looked at first: the rule reads all of a text."""
    at_end = F.left(text, F.lit(1)).rlike(r"(?U)\s") | F.right(text, F.lit(1)).rlike(r"(?U)\s")
    return F.when(at_end, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


#: What a text with a page number's line matches; most texts don't.
_MAY_HAVE_NUMBER = r"(?m)^[^\p{L}\p{Nd}\n]*+\p{Nd}{1,4}[^\p{L}\p{Nd}\n]*$"


def drop_page_numbers(text: Column) -> Column:
    """Lines that are only a decorated number of one to four digits go; lines are joined by line feeds."""
    broken = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_BREAKS, "\n" * len(LINE_BREAKS))
    lines = F.when(text.rlike(f"[{LINE_BREAKS}]"), broken).otherwise(text)
    kept = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")
    whole = F.when(F.endswith(lines, F.lit("\n")), F.regexp_replace(lines, r"\n\z", "")).otherwise(lines)
    return F.when(whole.rlike(_MAY_HAVE_NUMBER), kept(whole)).otherwise(whole)


def drop_note_marks(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, NOTE_MARK, "")).otherwise(text)


def drop_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("\u00ad"), F.lit(""))


def pre_clean(text: Column) -> Column:
    return drop_soft_hyphens(drop_note_marks(drop_page_numbers(text)))


def collapse_ellipses(text: Column) -> Column:
    return F.regexp_replace(text, r"\.(?:[ \t]*\.)+", "…")


def soften_semicolons(text: Column) -> Column:
    return F.replace(text, F.lit(";"), F.lit(","))


def space_ellipses(text: Column) -> Column:
    """A space before an ellipsis that follows a word character."""
    return F.when(F.contains(text, F.lit("…")), F.regexp_replace(text, r"(?U)(?<=\w)…", " …")).otherwise(text)


def normalise(text: Column) -> Column:
    return space_ellipses(soften_semicolons(collapse_ellipses(text)))


def is_citation(inner: Column) -> Column:
    """Whether the inside of a parenthetical begins like a reference."""
    return inner.rlike(rf"(?U)^{CITATION}")


def strip_citations(text: Column) -> Column:
    gone = F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, CITED, "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(gone, r"[ \t]{2,}", " "), r"(?U)\s+([,.;:])", "$1")


def clean_text(text: Column, drop_citations: bool = False) -> Column:
    """Pre-cleaned, normalised (ellipses first, out of reach of the citation rule), citations dropped if asked, white space squeezed."""
    out = normalise(pre_clean(text))
    if drop_citations:
        out = strip_citations(out)
    squeezed = F.regexp_replace(out, r"[ \t]{2,}|\t", " ")  # a single space is as it shall be
    return trimmed(F.regexp_replace(squeezed, r"\n{3,}", "\n\n"))


def derive_title(text: Column, longest: int = 60) -> Column:
    """The first sentence, cut at a word when long; null for empty text."""
    first = trimmed(F.regexp_extract(trimmed(text), r"(?Us)^(.*?)(?:(?<=[.!?])\s|$)", 1))
    head = F.substring(first, 1, longest)
    at_word = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    cut = F.when(F.length(first) > longest, F.concat(at_word, F.lit("…"))).otherwise(first)
    return F.when(first != "", F.regexp_replace(cut, r"\.+$", ""))


def is_front_matter(title: Column) -> Column:
    return F.coalesce(title.rlike(FRONT_MATTER), F.lit(False))


def fingerprint(chunks: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of chunks joined by NUL."""
    return F.left(F.sha2(F.array_join(chunks, "\0").cast("binary"), 256), F.lit(16))


def aligned_word(word: Column) -> Column:
    """A word as the aligner sees it: letters and inner apostrophes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(word, "’", "'")), "[^a-z']", ""), "^'+|'+$", "")


def matched_word(word: Column) -> Column:
    """A word as printed and spoken text are compared: letters, digits and apostrophes."""
    return F.regexp_replace(F.lower(F.translate(word, "’", "'")), "[^0-9a-z']", "")


def words(text: Column) -> Column:
    """White-space separated words; none of empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def escape_metadata(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\=;#\n\r])", "\\\\$1")


def resolve_href(base: Column, href: Column) -> Column:
    """A link of a document without its fragment, against the document's folder, with dot segments folded."""
    path = F.substring_index(href, "#", 1)
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path)), "/")
    none = F.array().cast("array<string>")

    def fold(acc, part):
        up = F.when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(parts, none, fold), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def clean_samples(samples: Column) -> Column:
    """NaN and infinities are silence, others are clamped to [-1, 1]."""
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(samples, lambda x: F.when(x.isNull() | odd(x), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))))


def error_tail(text: Column) -> Column:
    return F.right(text, F.lit(4000))


def last_lines(text: Column, n: int = 3) -> Column:
    lines = F.split(F.regexp_replace(text, r"(?U)\s+$", ""), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def whole(x: Column) -> Column:
    """Rounded with halves up."""
    return F.floor(x + 0.5)


def duration_label(seconds: Column) -> Column:
    minutes = whole(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(seconds < 60, F.concat(whole(seconds).cast("string"), F.lit("s"))).when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def size_label(size: Column) -> Column:
    tenths = whole(size / 1e9 * 10)
    gb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" GB"))
    return F.when(size >= 1e9, gb).when(size >= 1e6, F.concat(whole(size / 1e6).cast("string"), F.lit(" MB"))).otherwise(F.concat(whole(size / 1e3).cast("string"), F.lit(" KB")))


def clock_label(seconds: Column) -> Column:
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    s = F.floor(F.when(finite, seconds).otherwise(0.0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def age_label(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit + " ago"))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "m")).otherwise(part(3600, "h"))


def time_left_label(left: Column) -> Column:
    return F.when(left.isNull(), "calculating").when(left <= 5, "almost done").otherwise(F.concat(duration_label(left), F.lit(" left")))


def joined_parts(*parts: Column) -> Column:
    """The parts that are present, joined by a middle dot."""
    return F.concat_ws(" · ", *parts)


# Labels shown for a stage and for where a title comes from, and picture types by extension.
STAGE_LABELS = {
    "draft": "Draft", "queued": "Queued", "parsing": "Parsing", "synthesizing": "Synthesizing", "assembling": "Assembling", "done": "Done", "failed": "Failed", "cancelled": "Cancelled",
}
SOURCE_LABELS = {"toc": "Table of contents", "heading": "Heading", "derived": "Opening words", "generic": "Numbered"}
PICTURE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The value of a constant table, null for other keys."""
    return reduce(lambda out, kv: out.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values()))))


def extension(name: Column) -> Column:
    """The lower-case extension with its dot; .jpg if there is none that is known."""
    found = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(found.isin(*PICTURE_TYPES), found).otherwise(".jpg")


GENERATION_PARAMETERS = ("exaggeration", "cfg_weight", "temperature")


def allowed_parameters(params: Column) -> Column:
    return F.map_filter(params, lambda k, v: k.isin(*GENERATION_PARAMETERS) & v.isNotNull())
