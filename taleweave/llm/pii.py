"""Personal data by patterns, and the terms that reveal it by information content; DataFrame functions only.

Base: e-mail addresses, IP addresses, payment cards and phone numbers, each found from the left without overlap.

Method: terms are weighed by the share of a protected entity's information that they give away, log(N c / (df_term df_entity)) /
log(N / df_entity), with N documents, df of term and of entity, and c of both together, all counted over the whole corpus.

* The first entities are the subjects of the texts themselves, and the terms that name them are codes: runs of 16 and more letters and digits with a digit,
  UUIDs, numbers of 16 digits. Most codes of a corpus are names of functions, hashes, parts of addresses and keys of tables, which protect nobody, however
  rare they are. So a code counts only for what it stands by or has the form of: the name of a secret right before it (SECRET), a known
  form of access key (KEY), or a number of a payment card's length among words (PLAIN, not in tables, paths or code). Such a code gives away log(N /
  subjects) of log N. Subjects are counted by the min-entropy of the code's contexts, the characters to either side of it: all its mentions over those
  in its most frequent context. A key or an account number has one subject, however often its text is copied; a number that is printed
  everywhere has many and stays.
* The others are the values found by patterns. Terms are words near their mentions (NEAR words to either side) that were seen with the
  value in SUPPORT different texts.

A term whose share reaches GENERALISE is replaced by a general word for what it is (`[code]`, `[number]`, `[name]`, `[word]`) where its
entity stands in the document; a word from REMOVE on is taken out. Codes are never taken out without a word in their place.

Scale: patterns are a map. Only documents with an entity or a code give terms; terms and pairs are counted with partial sums before
each shuffle. Terms that are too frequent among those documents alone are out. The others' document frequencies come from all
words of all documents, joined with these terms (sent to executors if measured and small, else joined by a shuffle) and
summed in each task first: a frequent word is one row a task. Within a text all steps are linear in its length and its spans: folds grow
in blocks, places are read from pages of the text, and spans are kept apart in one pass over their order.

Defined cases: null text is the empty text, and stays null when sanitised. Rows that repeat count each as a document;
texts that are equal support a pair once. Of terms with equal shares all are taken, and each of a term's places. Spans of different
kinds may overlap, but for terms, which lie beside all others; in sanitised text what they cover is replaced once, by the first kind.
Null ids are kept. Very long texts are read whole. Other columns are kept as they are, n_chars is counted anew. An empty table
gives an empty one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm.lineage import broadcast_if_small, stored
from taleweave.operators.folding import PAGE, bound, fold, pages, passage

# Kinds in their order, with what matches. Each is written so that no start within a run is tried twice.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)++|[0-9]{2,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Codes: candidates for terms that name the subject of a text.
CODE = r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{4}(?:[ -][0-9]{4}){3}|[A-Za-z0-9_]{16,}+)(?![A-Za-z0-9_])"
# Names of secrets, as they stand right before one; forms of access keys; and what stands beside a number in tables, paths and code.
SECRET = (
    r"(?i)(?<![a-z])(?:token|secret|password|passwd|passphrase|passcode|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|secret[ _-]?key|auth|authorization|authentication|bearer|credentials?|account|account number|iban|card|card number|ssn)"
    r"""["'”]?\s{0,3}(?:=>|->|[:=]|\bis\b)?\s{0,3}["'“]?$"""
)
KEY = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,})$"
PLAIN, BESIDE_BEFORE, BESIDE_AFTER = r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$", r"[|/\\=#&?_{}\[\]<>:;,-]\s*$", r"^\s*[|/\\=#&_{}\[\]<>]"
#: Characters before a code in which the name of a secret is looked for.
NAMED = 40
#: What a text must contain for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

NEAR, SUPPORT, GENERALISE, REMOVE = 5, 3, 0.8, 0.97
#: Characters to either side of a mention in which the near words are looked for, and those that are a code's context.
REACH, CONTEXT = 120, 16
_MARK, _OTHER = "\x01", "\x02"  # neither is part of any pattern
_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_SPANS = f"array<{_SPAN}>"


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "code":
        return F.length(digits) > 0
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """The spans of one kind, in code points: matches are marked, the text is split at the marks, and lengths are added up."""
    pattern = CODE if kind == "code" else PATTERNS[kind]
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def step(state, part):
        end = state["at"] + F.length(part)
        span = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside")), state["inside"] & valid(kind, part), span

    found = fold(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside")), step, _SPAN)["out"]
    hint = F.contains(text, F.lit(HINTS[kind])) if HINTS.get(kind) else F.lit(True)
    return F.when(hint & text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by kind as listed, then start."""
    return F.concat(*[kind_spans(text, k) for k in KINDS])


def apart(items: Column, spans: Column) -> Column:
    """The items (spans that don't overlap each other) that overlap none of the spans, in order of their start; one pass over all in that order."""
    both = F.sort_array(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("own"), s.alias("s"))), F.transform(items, lambda s: F.struct(s["start"].alias("start"), F.lit(True).alias("own"), s.alias("s"))),
    ))

    def step(state, x):
        held, own, s = state["held"], x["own"], x["s"]  # an item is held until it is known that what begins next doesn't reach into it
        free = held.isNotNull() & (own | (held["end"] <= s["start"]))
        reach = F.when(own, state["reach"]).otherwise(F.greatest(state["reach"], s["end"]))
        return F.struct(reach.alias("reach"), F.when(own & (s["start"] >= state["reach"]), s).alias("held")), free, held

    start = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(_SPAN).alias("held"))
    whole = bound(fold(both, start, step, _SPAN), lambda f: F.when(f["state"]["held"].isNotNull(), F.concat(f["out"], F.array(f["state"]["held"]))).otherwise(f["out"]))
    return F.when(F.size(items) == 0, items).when(F.size(spans) == 0, items).otherwise(whole)


def protected(paged: Column, code: Column) -> Column:
    """Whether a code stands for a subject: by the name of a secret before it, its form, or as a number among words."""
    before, after = passage(paged, code["start"] - NAMED, code["start"]), passage(paged, code["end"], code["end"] + 4)
    return code["value"].rlike(KEY) | before.rlike(SECRET) | (code["value"].rlike(PLAIN) & ~before.rlike(BESIDE_BEFORE) & ~after.rlike(BESIDE_AFTER))


def text_key(text: Column) -> Column:
    return F.concat(F.xxhash64(text).cast("string"), F.lit(":"), F.length(text).cast("string"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1)


def _mentions(held: DataFrame) -> DataFrame:
    """(doc_id, key, entity, term) of the words near each mention."""
    paged = held.select("doc_id", "key", pages(F.col("text")).alias("pages"), "spans")

    def near(s):
        before, after = words_of(passage(F.col("pages"), s["start"] - REACH, s["start"])), words_of(passage(F.col("pages"), s["end"], s["end"] + REACH))
        return F.concat(F.reverse(F.slice(F.reverse(before), 1, NEAR)), F.slice(after, 1, NEAR))

    each = paged.select("doc_id", "key", F.explode(F.transform("spans", lambda s: F.struct(_entity(s).alias("entity"), F.array_distinct(near(s)).alias("terms")))).alias("m"))
    return each.select("doc_id", "key", "m.entity", F.explode("m.terms").alias("term"))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def code_shares(held: DataFrame, n: float) -> DataFrame:
    """(value, subjects, share) of each code in held (codes, text): how much of its subject's information it gives away."""
    paged = held.select("codes", pages(F.col("text")).alias("pages"))
    near = lambda c: F.xxhash64(passage(F.col("pages"), c["start"] - CONTEXT, c["start"]), passage(F.col("pages"), c["end"], c["end"] + CONTEXT))
    mentions = paged.select(F.explode(F.transform("codes", lambda c: F.struct(c["value"].alias("value"), near(c).alias("context")))).alias("m")).select("m.*")
    contexts = mentions.groupBy("value", "context").agg(F.count("*").alias("n"))
    subjects = contexts.groupBy("value").agg((F.sum("n") / F.max("n")).alias("subjects"))
    return subjects.withColumn("share", F.greatest(F.log(F.lit(n) / F.col("subjects")) / F.log(F.lit(n)), F.lit(0.0)))


def disclosing_terms(docs: DataFrame, held: DataFrame, rows: float) -> DataFrame:
    """(term, entity, share) of the terms that reveal an entity. held: doc_id, key, text, spans of the documents with entities; rows: of docs."""
    near = stored(_mentions(held).distinct())
    seen = near.groupBy("entity", "term", "key").agg(F.count("*").alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("together"), F.count("*").alias("texts"))
    entities = held.select("doc_id", "key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    pairs = stored(seen.where(F.col("texts") >= SUPPORT).join(entities, "entity"))
    n = F.lit(rows)

    def share(df_term):
        return F.log(F.col("together") * n / (F.col(df_term) * F.col("df_entity"))) / F.log(F.greatest(n / F.col("df_entity"), F.lit(1.0001)))

    def frequencies(rows, terms, name):
        words = rows.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
        return words.join(broadcast_if_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias(name))

    # A term is in at least the documents with entities that hold it; those too frequent there already can't reach the threshold.
    likely = stored(pairs.join(frequencies(held, stored(pairs.select("term").distinct()), "df_held"), "term").where(share("df_held") >= GENERALISE))
    known = likely.join(frequencies(docs, stored(likely.select("term").distinct()), "df_term"), "term")
    return known.select("term", "entity", F.least(share("df_term"), F.lit(1.0)).alias("share")).where(F.col("share") >= GENERALISE)


def word_spans(held: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, span) of the places where a revealing word stands in a document with its entity."""
    entity = F.transform("spans", _entity)
    pairs = held.select("doc_id", "key", F.explode(F.array_distinct(entity)).alias("entity")).join(broadcast_if_small(terms), "entity")
    shares = pairs.groupBy("doc_id", "key", "term").agg(F.max("share").alias("share")).groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    shares = shares.withColumnsRenamed({"doc_id": "__pii_id", "key": "__pii_key"})
    # Only documents with such a term are gone through word by word; positions add up, and places of terms alone are kept.
    rows = held.join(shares, F.col("doc_id").eqNullSafe(F.col("__pii_id")) & (F.col("key") == F.col("__pii_key")))
    parts = F.split(F.regexp_replace(F.translate("text", _MARK, _OTHER), r"\p{L}{3,}+", f"{_MARK}$0{_MARK}"), _MARK)

    def step(at, part):
        end, share = at + F.length(part), F.try_element_at("shares", F.lower(part))
        return end, share.isNotNull(), F.struct(_done(share).alias("kind"), at.alias("start"), end.alias("end"), part.alias("value"))

    places = fold(parts, F.lit(0), step, _SPAN)["out"]
    return rows.select("doc_id", "key", F.explode(apart(places, F.concat("spans", "codes"))).alias("span"))


def _done(share: Column) -> Column:
    return F.when(share >= REMOVE, "removed").otherwise("term")


def term_spans(held: DataFrame, words: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, key, terms): the places of revealing words and codes in each document that has some, in order. Codes are generalised, never removed."""
    each = held.select("doc_id", "key", F.explode("codes").alias("c")).join(broadcast_if_small(codes.where(F.col("share") >= GENERALISE)), F.col("c.value") == F.col("value"))
    found = each.select("doc_id", "key", F.struct(F.lit("term").alias("kind"), "c.start", "c.end", "c.value").alias("span"))
    order = lambda a, b: a["start"] - b["start"]
    return word_spans(held.where("size(spans) > 0"), words).unionByName(found).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("span"), order).alias("terms"))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (base) and terms (revealing) of each row."""
    text = F.coalesce("text", F.lit(""))
    codes = F.filter(kind_spans(text, "code"), lambda c: protected(F.col("pages"), c))
    found = docs.select("doc_id", text_key(text).alias("key"), base_spans(text).alias("spans"), text.alias("text"), pages(text).alias("pages"))
    found = found.withColumn("codes", codes).withColumn("codes", apart(F.col("codes"), F.col("spans"))).drop("pages")
    found = stored(found.withColumn("text", F.when((F.size("spans") > 0) | (F.size("codes") > 0), F.col("text"))))
    held, n = found.where("text is not null"), float(max(found.count(), 2))
    words = stored(disclosing_terms(docs, held.where("size(spans) > 0"), n))
    terms = stored(term_spans(held.dropDuplicates(["doc_id", "key"]), words, stored(code_shares(held, n))))
    joined = found.select("doc_id", "key", "spans").join(broadcast_if_small(terms.withColumnsRenamed({"doc_id": "__pii_id", "key": "__pii_key"})), F.col("doc_id").eqNullSafe(F.col("__pii_id")) & (F.col("key") == F.col("__pii_key")), "left")
    return joined.select("doc_id", "key", "spans", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row. The method's spans follow the base kinds: `term` (to be generalised), then `removed`."""
    by_kind = F.concat("spans", F.filter("terms", lambda s: s["kind"] == "term"), F.filter("terms", lambda s: s["kind"] == "removed"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans_of(docs).select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(by_kind).alias("spans"))


def general_word(value: Column) -> Column:
    """What a term is, in general."""
    return F.when(value.rlike("^[0-9 -]+$"), "number").when(value.rlike("[0-9]"), "code").when(value.rlike(r"^\p{Lu}"), "name").otherwise("word")


def replaced(text: Column, spans: Column) -> Column:
    """The text with what the spans cover replaced by their kind or general word in brackets; `removed` is replaced by nothing."""

    def whole(paged):
        def step(at, s):
            before = passage(paged, at, F.greatest(s["start"], at))
            put = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.when(s["kind"] == "term", general_word(s["value"])).otherwise(s["kind"]), F.lit("]")))
            more = s["end"] > at
            return F.when(more, s["end"]).otherwise(at), more, F.concat(before, put)

        ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
        return bound(fold(ordered, F.lit(0), step, "string"), lambda f: F.concat(F.array_join(f["out"], ""), passage(paged, f["state"], F.size(paged) * F.lit(PAGE))))

    return bound(pages(text), whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data and revealing terms replaced; all rows and columns stay."""
    found = spans_of(docs).select("doc_id", "key", F.concat("spans", "terms").alias("__pii_spans")).where("size(__pii_spans) > 0").dropDuplicates(["doc_id", "key"])
    found = stored(found).withColumnsRenamed({"doc_id": "__pii_id", "key": "__pii_key"})
    key = text_key(F.coalesce("text", F.lit("")))
    held = docs.withColumn("__pii_mine", key).join(broadcast_if_small(found), F.col("doc_id").eqNullSafe(F.col("__pii_id")) & (F.col("__pii_mine") == F.col("__pii_key")), "left")
    text = F.when(F.col("__pii_spans").isNotNull(), replaced(F.col("text"), F.col("__pii_spans"))).otherwise(F.col("text"))
    out = held.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
