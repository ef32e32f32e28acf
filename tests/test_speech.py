"""Text preparation, sentences and chunks on hand-written rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from taleweave.functions import speech as S
from taleweave.operators import chunking, citations, folding, markup


def values(spark, texts, f, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t")).alias("v")).collect()]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (S.drop_page_numbers, "one\n- 42 -\ntwo\n[7]\n12345", "one\ntwo\n12345"),
        (S.drop_page_numbers, "a\r\nb\n", "a\nb"),
        (S.drop_page_numbers, "a b c d", "a b c d"),
        (S.drop_note_marks, "x[7] y[note 3] z[1234] [ 12 ]", "x y z[1234] "),
        (S.drop_soft_hyphens, "so­ft", "soft"),
        (S.collapse_ellipses, "a . . . b ... c. d", "a … b … c. d"),
        (S.space_ellipses, "Lord…same é… …", "Lord …same é … …"),
        (S.strip_citations, "he says (Rom. 12:4), we (see p. 3) go (an aside here) (See p. 4)", "he says, we go (an aside here) (See p. 4)"),
        (S.strip_citations, "lead (see the whole long story of it) end", "lead end"),
        (S.strip_citations, "year (1985) and (" + "9" * 91 + ")", "year and (" + "9" * 91 + ")"),
        (lambda c: S.clean_text(c, True), "a; b  [3]\n\n\n\nc (v. 2) .", "a, b \n\nc."),
        (S.derive_title, "Short one. More", "Short one"),
        (S.derive_title, "", None),
        (S.derive_title, "word " * 30, ("word " * 12).strip() + "…"),
        (S.escape_metadata, "a=b;c#d\\e\n", "a\\=b\\;c\\#d\\\\e\\\n"),
        (lambda c: S.resolve_href(F.lit("a/b/t.xhtml"), c), "../img/./x.png#f", "a/img/x.png"),
        (S.aligned_word, "‘Don’t!", "don't"),
        (S.matched_word, "Don’t-1", "don't1"),
        (lambda c: S.last_lines(c), "a\nb\nc\nd\n\n", "b\nc\nd"),
    ],
)
def test_text(spark, f, given, wanted):
    assert values(spark, [given, None], f) == [wanted, None]


def test_labels(spark):
    assert values(spark, [32380.0, 59.0, 3599.0, 90.0], S.duration_label, "double") == ["9h 0m", "59s", "1h 0m", "2m"]
    assert values(spark, [2.5e9, 1.5e6, 900.0], S.size_label, "double") == ["2.5 GB", "2 MB", "1 KB"]
    assert values(spark, [3661.9, float("nan"), 59.0, None], S.clock_label, "double") == ["1:01:01", "0:00", "0:59", "0:00"]
    assert values(spark, [-5.0, 61.0, 7300.0], S.age_label, "double") == ["0s ago", "1m ago", "2h ago"]
    assert values(spark, ["a/Cover.PNG", "x", "y.tiff"], S.extension) == [".png", ".jpg", ".jpg"]
    assert values(spark, ["Table of Contents", "The index", "acknowledgements", None], S.is_front_matter) == [True, False, True, False]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Dr. Ann Lee came. J. I. Poe left!", ["Dr. Ann Lee came.", "J. I. Poe left!"]),
        ("1. First item. 2. Second item.", ["1. First item.", "2. Second item."]),
        ("1. 2. Foo bar.", ["1. 2.", "Foo bar."]),
        ("He was born in 1985. Later he left. and stayed.", ["He was born in 1985.", "Later he left. and stayed."]),
        ("“Go.” She went. (Really.) Yes", ["“Go.", "She went.", "(Really.", "Yes"]),
        ("Rom. 12:4 says so. The U.S. Army", ["Rom. 12:4 says so.", "The U.S.", "Army"]),
        ("One. Two? Three", ["One.", "Two?", "Three"]),
        ("", []),
    ],
)
def test_sentences(spark, given, wanted):
    assert values(spark, [given], chunking.sentences) == [wanted]


def test_fit(spark):
    got = values(spark, ["aaaa, bbbb cccc dddd", "x" * 25, "ab, " + "y" * 18, "short"], lambda c: chunking.fit(c, 10))
    assert got == [["aaaa,", "bbbb cccc", "dddd"], ["x" * 11, "x" * 11, "xxx"], ["ab,", "y" * 11, "y" * 7], ["short"]]


def test_chunks_hold_their_bounds(spark):
    rng = random.Random(3)
    words = ["Dr.", "word", "it,", "end.", "So", "a" * 40, "“q.”", "(x)", "e.g.", "No!"]
    texts = ["\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    held = chunking.chunk_paragraphs(chunking.paragraphs(docs), 100)
    flat = chunking.flat_chunks(held, ["doc_id"]).orderBy("doc_id", "chunk_no").collect()
    assert max(len(r["chunk"]) for r in flat) <= 101
    letters = lambda s: "".join(c for c in s if c.isalnum() or c in ",(")
    for i, text in enumerate(texts):
        assert letters("".join(r["chunk"] for r in flat if r["doc_id"] == i)) == letters(text)
    shuffled = chunking.chunk_paragraphs(chunking.paragraphs(docs.repartition(7)), 100)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, held.collect()))


def test_citations_found_are_those_removed(spark):
    docs = spark.createDataFrame([(1, "b", "One (Rom. 1:2) two (aside words here) three (ibid.) (1990)."), (2, "b", "none"), (3, "b", None)], "doc_id int, book string, text string")
    found = citations.find_citations(docs, ["book", "doc_id"]).orderBy("occurrence").collect()
    assert [r["citation"] for r in found] == ["(Rom. 1:2)", "(ibid.)", "(1990)"]
    assert found[1]["before"].endswith("three") and found[1]["after"] == "(1990)."
    assert citations.counts(citations.find_citations(docs, ["book", "doc_id"]), "book", "doc_id").first()["citations"] == 3


def test_trimming_looks_at_the_ends_first(spark):
    """Texts without white space at an end aren't read by the rule; all come out as by the rule alone."""
    import re

    texts = ["", " ", "a", "a b", " a", "a ", "\na\n", "a \n", "\u2003a\u2028", "a\u0085", "\u00a0a b", "𝄞 𝄞", " 𝄞", "a\tb  c\t d \n\n\n\n e"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.trimmed(F.col("t")), S.clean_text(F.col("t"))).collect()]
    assert [g[:2] for g in got] == [(t, re.sub(r"^\s+|\s+$", "", t)) for t in texts] and got[-1][2] == "a b c d \n\n e"
    assert "CASE WHEN" in str(S.trimmed(F.col("t"))) and r"[ \t]+" not in str(S.clean_text(F.col("t")))


def test_text_path_has_no_python(spark, sf_dir):
    from taleweave.plans import QUERIES

    plan = QUERIES["flagship_chunked_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_long_sentences_and_paragraphs(spark):
    """Cutting and packing over many windows and blocks, against plain Python; and texts of megabytes in time that grows with their length."""
    rng = random.Random(1)

    def fitted(s, most):
        out = []
        while len(s) > most:
            comma, space = s[:most].rfind(","), s[:most].rfind(" ")
            cut = comma if comma >= most // 2 else space if space > 0 else most
            out.append(s[: cut + 1].strip())
            s = s[cut + 1 :].strip()
        return out + [s] if s else out

    def packed(pieces, most):
        out = []
        for p in pieces:
            if out and len(out[-1]) + 1 + len(p) <= most:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    texts = ["".join(rng.choice(["a", "bb", "ccc", ", ", " ", "  ", "é", "x" * rng.randint(1, 40)]) for _ in range(rng.choice([5, 40, 300, 3000]))).strip() for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for most in (10, 30):
        got = rows.select("i", chunking.fit(F.col("s"), most).alias("f")).withColumn("p", chunking.pack(F.col("f"), most)).collect()
        assert all(r["f"] == fitted(texts[r["i"]], most) and r["p"] == packed(r["f"], most) for r in got)
    seconds = []
    for n in (30_000, 300_000):
        held = spark.createDataFrame([(0, 0, "A short one stands, here. " * (n // 2) + "no end, of it " * n)], "i int, para_no int, paragraph string").select("i", "para_no", "paragraph")
        began = time.time()
        chunks = chunking.chunk_paragraphs(held).select("chunks").first()[0]
        seconds.append(time.time() - began)
        assert max(map(len, chunks)) <= 301 and len(" ".join(chunks)) == 26 * (n // 2) + 14 * n - 1
    assert seconds[1] < 10 * seconds[0] + 20


def test_noncharacters_stay(spark):
    got = values(spark, ["One \ufdd0 here. Two."], chunking.sentences)
    assert got == [["One \ufdd0 here.", "Two."]]
    assert [r["text"] for r in markup.blocks(spark.createDataFrame([(1, "<p>a \ufdd0 &amp; b</p>")], "k int, html string"), "k").collect()] == ["a \ufdd0 & b"]


def test_passages_of_pages(spark):
    rng, text = random.Random(3), "".join(random.Random(4).choice("aé😀\n") for _ in range(3 * folding.PAGE + 17))
    spans = [(0, 0), (0, 1), (folding.PAGE - 1, folding.PAGE + 1), (0, len(text)), (5, 4), (-3, 2), (len(text) - 1, len(text) + 9)] + [tuple(sorted(rng.choices(range(len(text)), k=2))) for _ in range(40)]
    held = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int").withColumn("p", folding.pages(F.col("t")))
    got = [r["x"] for r in held.select(folding.passage(F.col("p"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [text[max(a, 0) : max(b, 0)] for a, b in spans]
