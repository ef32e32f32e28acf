"""Timelines, refresh, life-cycle and markup on hand-written rows."""

import datetime
import io
import itertools
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from taleweave.operators import catalog, markup, refresh, scans
from taleweave.operators import timeline as T
from taleweave.sources import archives, files
from taleweave.streaming import streams, twins
from taleweave.streaming.lifecycle import RUNNING, TRANSITIONS, begin, fold


def test_gap_fill_reads_what_it_wrote(spark):
    rows = [(1, 1, None, None), (1, 2, None, None), (1, 3, 2.0, 3.0), (1, 4, None, None), (1, 5, None, None), (2, 1, None, None)]
    words = spark.createDataFrame([(*r, 9.0) for r in rows], "seg int, n int, start double, end double, clip_seconds double")
    got = [(r["start"], r["end"]) for r in T.fill_untimed(words, "seg", "n").orderBy("seg", "n").collect()]
    assert got == [(0.0, 2.0), (2.0, 2.0), (2.0, 3.0), (3.0, 9.0), (9.0, 9.0), (0.0, 9.0)]


def test_sound_runs(spark):
    level = [0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0]
    samples = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(level)], "s int, p int, a double")
    got = T.sound_runs(samples, "s", "p", F.col("a") == 0, 2).orderBy("run").collect()
    assert [(r["first"], r["last"]) for r in got] == [(2, 5), (8, 8)]


def test_lookups(spark):
    spans = spark.createDataFrame([("b", 0, 0.0, 2.0), ("b", 1, 2.0, 4.0), ("b", 2, 5.0, 6.0)], "book string, n int, start double, end double")
    times = [-1.0, 0.0, 2.0, 4.5, 5.5, 7.0]
    look = spark.createDataFrame([("b", t) for t in times], "book string, t double")
    last = {r["t"]: r["n"] for r in T.as_of(look, spans, "book", "t", ["n"], first_if_before=True).collect()}
    assert [last[t] for t in times] == [0, 0, 1, 1, 2, 2]
    held = {r["t"]: r["n"] for r in T.span_at(look, spans, "book", "t", ["n"]).collect()}
    assert [held[t] for t in times] == [None, 0, 0, None, 2, None]


def test_read_along_gates_on_counts(spark):
    printed = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(3)], "ch int, ordinal int")
    spoken = spark.createDataFrame([(1, i, float(i), i + 1.0) for i in range(3)] + [(2, 0, 0.0, 1.0)], "ch int, ordinal int, start double, end double")
    got = T.read_along(spoken, printed, "ch").orderBy("ch", "ordinal").collect()
    assert [r["aligned"] for r in got] == [True] * 3 + [False] * 3 and [r["start"] for r in got] == [0.0, 1.0, 2.0, None, None, None]


@pytest.mark.parametrize(
    "have, stale",
    [
        ([(0, "v"), (1, "v")], False), ([(0, "v")], False), ([(0, "old")], True), ([(0, None), (1, None)], False), ([(0, None)], True), ([(0, "v"), (2, "v")], True), ([], False), ([(0, None), (1, None), (2, None)], True),
    ],
)
def test_staleness(spark, have, stale):
    want = spark.createDataFrame([(1, 0, "v"), (1, 1, "v")], "ch int, part int, sig string")
    stored = spark.createDataFrame([(1, *h) for h in have], "ch int, part int, sig string")
    assert refresh.stale_chapters(want, stored, ["ch"]).first()["stale"] is stale
    left = sorted(r["part"] for r in refresh.to_do(want, stored, ["ch"]).collect())
    assert left == ([0, 1] if stale else sorted({0, 1} - {p for p, _ in have}))


def test_life_cycle_rules():
    statuses = [None, "draft", "queued", *sorted(RUNNING), "done", "failed", "cancelled"]
    for status, command, online in itertools.product(statuses, [*TRANSITIONS, "cancel", "nonsense"], (True, False)):
        state = fold(begin() | {"status": status}, command, online)
        if command == "cancel":
            stops = status == "queued" or (status in RUNNING and not online)
            assert state["status"] == ("cancelled" if stops else status)
            assert state["cancel"] is (status in RUNNING and online)
        elif command in TRANSITIONS and status in TRANSITIONS[command][0]:
            assert state["status"] == TRANSITIONS[command][1]
        else:
            assert state["status"] == status and state["rejected"] == 1


def test_a_job_begins_with_nothing():
    state = fold(None, "claim")
    assert state["status"] is None and state["rejected"] == 1
    for command, status in (("analyze", "draft"), ("start", "queued"), ("claim", "parsing"), ("planned", "synthesizing"), ("rendered", "assembling"), ("uploaded", "done"), ("delete", None), ("analyze", "draft")):
        state = fold(state, command)
        assert state["status"] == status
    flagged = fold(fold(fold(fold(fold(None, "analyze"), "start"), "claim"), "cancel"), "rescue")
    assert flagged["status"] == "queued" and flagged["cancel"] is False


def test_archives_arrive_once(spark, tmp_path):
    """Files land in a folder in two rounds; a stream reads each once, and refuses what is no archive or too large."""
    def book(name, pages, title=None):
        with zipfile.ZipFile(tmp_path / "in" / f"{name}.epub", "w") as z:
            items = "".join(f"<item id='i{k}' href='t/{k}.xhtml' media-type='application/xhtml+xml'/>" for k in range(len(pages)))
            z.writestr("a/content.opf", f"<package xmlns:dc='d'><metadata>{title or ''}</metadata><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(39)}i{k}{chr(39)}/>' for k in range(len(pages)))}<itemref idref='none'/></spine></package>")
            for k, page in enumerate(pages):
                z.writestr(f"a/t/{k}.xhtml", page)

    (tmp_path / "in").mkdir()
    page = lambda head, n: f"<html><body><h1>{head}</h1><p>{'word ' * n}</p></body></html>"
    book("one", [page("Contents", 60), page("First", 60), page("Short", 3), page("Second", 60)], "<dc:title>A Title</dc:title>")
    (tmp_path / "in" / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "in" / "other.txt").write_bytes(b"not looked at")
    book("large", [page("Big", 9000)])
    made, refused = streams.new_books(streams.archive_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), 40_000)
    got = made.orderBy("index").collect()
    assert [(r["book_id"], r["book_title"], r["author"], r["index"], r["title"], r["source"], r["include"]) for r in got] == [
        ("one", "A Title", "Unknown", 0, "Contents", "heading", False), ("one", "A Title", "Unknown", 1, "First", "heading", True), ("one", "A Title", "Unknown", 2, "Second", "heading", True),
    ]
    assert {(r["book_id"], r["verdict"]) for r in refused.collect()} == {("bad", "not an archive"), ("large", "too large")}
    # The same stream goes on from its checkpoint: what was read is not read again.
    state, found = str(tmp_path / "state"), []

    def run():
        stream = streams.archive_stream(spark, str(tmp_path / "in")).select("book_id")
        stream.writeStream.foreachBatch(lambda rows, _: found.extend(r["book_id"] for r in rows.collect())).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    book("two", [page("Later", 60)])
    run()
    assert sorted(found) == ["bad", "large", "one", "two"]


def test_a_failed_batch_of_books_gives_no_repeats(spark, tmp_path, monkeypatch):
    """The second output fails after the first was written; run again, both hold each book once. A book that lands again replaces itself."""
    page = f"<html><body><h1>One</h1><p>{'word ' * 60}</p></body></html>"

    def land(name, title):
        with zipfile.ZipFile(tmp_path / "in" / f"{name}.epub", "w") as z:
            z.writestr("p.opf", f"<package xmlns:dc='d'><metadata><dc:title>{title}</dc:title></metadata><manifest><item id='a' href='a.xhtml'/></manifest><spine><itemref idref='a'/></spine></package>")
            z.writestr("a.xhtml", page)

    (tmp_path / "in").mkdir()
    land("x", "First")
    (tmp_path / "in" / "bad.epub").write_bytes(b"nothing")
    run = lambda: [sorted(r[0] + "/" + str(r[1]) for r in d.collect()) for d in streams.new_books(streams.archive_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"))]
    right = streams.judge
    monkeypatch.setattr(streams, "judge", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        run()
    assert len(spark.read.parquet(str(tmp_path / "out" / "drafts")).collect()) == 1
    monkeypatch.setattr(streams, "judge", right)
    assert run() == [["x/First"], ["bad/0"]] == run()
    land("y", "Other")
    os.utime(tmp_path / "in" / "x.epub", (4e9, 4e9))
    assert run() == [["x/First", "y/Other"], ["bad/0"]]


def test_contents_come_from_the_package(spark, tmp_path):
    """Container, package, manifest, toc: other packages, other navigation files, landmarks and page lists don't count."""
    def book(name, files_):
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w") as z:
            for path, text in files_.items():
                z.writestr(path, text)

    container = "<container><rootfiles><rootfile full-path='{}'/></rootfiles></container>"
    package = "<package xmlns:dc='d'><metadata><dc:title>{}</dc:title></metadata><manifest><item id='n' href='{}' properties='nav'/><item id='a' href='a%20b.xhtml'/></manifest><spine/></package>"
    epub = "xmlns:epub='http://www.idpf.org/2007/ops'"
    nested = (
        f"<html {epub}><nav epub:type='page-list'><a href='p1'>1</a></nav><nav epub:type='lot toc'><ol><li><a href='../a%20b.xhtml#s'>One &amp; <b>a half</b></a><ol><li><a href='../a%20b.xhtml#t'>Inner</a></li></ol></li>"
        f"<li><span>Part&nbsp;two</span><ol><li><a href='c.xhtml'>Three</a></li></ol></li></ol></nav><nav epub:type='landmarks'><a href='x'>Start</a></nav></html>"
    )
    book("deep", {"META-INF/container.xml": container.format("z/real.opf"), "a.opf": package.format("Decoy", "nav.xhtml"), "nav.xhtml": "<nav><a href='d'>Decoy</a></nav>", "z/real.opf": package.format("Real", "sub/any.name"), "z/sub/any.name": nested})
    book("plain", {"b/x.opf": package.format("Plain", "nav.xhtml"), "b/nav.xhtml": "<html><nav><ol><li><a href='q.xhtml'>Only</a></li></ol></nav><nav epub:type='landmarks' xmlns:epub='e'><a href='x'>Start</a></nav></html>"})
    book("astray", {"META-INF/container.xml": container.format("gone.opf"), "b/x.opf": package.format("Astray", "none.xhtml")})
    book("torn", {"META-INF/container.xml": "<container", "x.opf": package.format("Torn", "nav.xhtml"), "nav.xhtml": "<nav><a href='q'>broken"})
    book("unread", {"x.opf": "<package"})
    parts = archives.members(archives.read_archives(spark, str(tmp_path)))
    assert {r["book_id"]: r["title"] for r in archives.packages(parts).collect()} == {"deep": "Real", "plain": "Plain", "astray": "Astray", "torn": "Torn"}
    got = sorted((r["book_id"], r["ord"], r["href"], r["title"]) for r in archives.contents(parts).collect())
    assert got == [
        ("deep", 0, "z/a b.xhtml#s", "One & a half"), ("deep", 1, "z/a b.xhtml#t", "Inner"), ("deep", 2, None, "Part two"), ("deep", 3, "z/sub/c.xhtml", "Three"), ("plain", 0, "b/q.xhtml", "Only"),
    ]


def _files_of_rows(spark, rows, schema, folder, n):
    """The rows dealt over n files, which a stream reads one by one."""
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.parquet(f"{folder}/{k:02d}")
    held = spark.read.parquet(f"{folder}/*")
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), held


def test_late_commands_take_their_place(spark, tmp_path):
    """Commands shuffled over files, and so over micro-batches, fold to the states of the batch twin once the watermark has passed them."""
    rng, at = random.Random(7), datetime.datetime(2024, 3, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i % 5, rng.choice(twins.COMMANDS), bool(i % 3)) for i in range(300)]
    shuffled = rng.sample(rows, len(rows)) + [(1000 + k, at + datetime.timedelta(days=40 + k), 99, "analyze", True) for k in range(2)]
    schema = "event_id long, ts timestamp, job long, command string, online boolean"
    stream, held = _files_of_rows(spark, shuffled[:-2], schema, f"{tmp_path}/in", 6)
    for k in (0, 1):
        spark.createDataFrame(shuffled[-2 + k :][:1], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9{k}")
    got = streams.drain(streams.job_states(stream, late="20 days"), str(tmp_path / "out")).where("job <> 99")
    want = twins.fold_commands(held)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rescues_come_once(spark, tmp_path):
    """Workers that fall silent, come back, end, are asked to cancel, or never sent a heartbeat; signs in one batch and in several."""
    at = datetime.datetime(2024, 3, 1)
    signs = [
        (1, 0, "beat", None), (1, 10, "claim", 11), (1, 40, "beat", None), (1, 300, "beat", None), (1, 900, "beat", None),  # silent twice, job 11 given back once
        (2, 0, "claim", 21), (2, 20, "end", 21), (2, 30, "claim", 22), (2, 50, "cancel", 22),  # 21 ended, 22 cancelled
        (3, 5, "claim", 31), (3, 200, "claim", 31), (3, 210, "claim", 32),  # claimed anew after it was given back
        (4, 0, "beat", None), (4, 50, "beat", None), (9, 5000, "beat", None), (9, 5001, "beat", None), (9, 9000, "beat", None),
    ]
    rows = [(w, at + datetime.timedelta(seconds=t), s, j) for w, t, s, j in signs]
    want = {(11, 1, 100, "queued"), (22, 2, 90, "cancelled"), (31, 3, 65, "queued"), (31, 3, 270, "queued"), (32, 3, 270, "queued")}
    for n in (1, 6):
        ordered = sorted(rows, key=lambda r: r[1])
        dealt = [r for k in range(n) for r in ordered[k * len(rows) // n : (k + 1) * len(rows) // n]]
        for k in range(n):
            spark.createDataFrame(dealt[k * len(rows) // n : (k + 1) * len(rows) // n], streams.SIGNS).coalesce(1).write.parquet(f"{tmp_path}/in{n}/{k}")
        stream = spark.readStream.schema(streams.SIGNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{n}/*")
        got = streams.drain(streams.rescues(stream, 60, late="10 seconds"), f"{tmp_path}/out{n}").collect()
        assert len(got) == len(want)
        assert {(r["job"], r["worker"], int((r["at"] - at).total_seconds()), r["becomes"]) for r in got} == want


def test_streams_equal_their_twins(spark, sf_dir, tmp_path):
    from taleweave.plans import QUERIES

    for stream, twin in (("st05_progress_stream", "st05_live_progress"),):
        rows = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in (stream, twin)]
        assert rows[0] == rows[1]


def test_back_off(spark):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{m:02d}:00", "k", ok) for i, (m, ok) in enumerate([(0, 0), (1, 0), (2, 0), (3, 1), (4, 0), (30, 0)])], "event_id int, ts string, key string, ok int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = twins.back_off(events, "key", F.col("ok") == 0, F.col("ok") == 1, free=1).orderBy("event_id").collect()
    assert [(r["failures"], r["wait_seconds"]) for r in got] == [(1, 0.0), (2, 2.0), (3, 4.0), (1, 0.0), (1, 0.0)]


def test_blocks(spark):
    html = '<html><body><ul><li><a href="x">a</a></ul></li><h1>T<!-- c --></h1><p>one <b>two</b><p><span>T</span>HE end &amp; all<sup>1</sup><blockquote class="q">x <p>y<i>z</i></p></blockquote><div>out</div></p></body></html>'
    pages = spark.createDataFrame([(1, html), (2, "<body>just text</body>"), (3, ""), (4, None)], "page int, html string")
    got = [(r["page"], r["tag"], r["text"]) for r in markup.blocks(pages, "page").orderBy("page", "block_no").collect()]
    assert got == [(1, "li", "a"), (1, "h1", "T"), (1, "p", "one two"), (1, "p", "THE end & all"), (1, "blockquote", "x yz"), (2, "p", "just text")]
    assert {r["page"]: r["heading"] for r in markup.headings(pages, "page").collect()}[1] == "T"


def test_references_are_those_of_a_parser(spark):
    """Named and numbered character references as Python's HTML parser reads them."""
    from html import unescape

    texts = ["caf&eacute; &mdash; it&#8217;s &#x2018;so&#X2019; &hellip;", "&amp;lt; &lt;b&gt; AT&T &nosuch; &copy 2024 &#0; &#xD800; &#x110000; &#150; &#x1F600;", "no reference", "&", "&&amp;&", "&NotEqualTilde; &notin; &frac12;&nbsp;x", "a\x01b &amp; c", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(markup.decoded(F.col("t"))).collect()]
    assert got == [t if t is None else unescape(t) for t in texts]


def test_cut_off_references_stay(spark):
    """A reference without its semicolon, as a title cut to a length ends in, is text in blocks, headings and wrapped words."""
    html = "<body><h1>one &amp; two&amp</h1><p>it&#39;s &lt so&#3</p></body>"
    page = spark.createDataFrame([(1, html), (2, "<body><b class='title'>x &amp; y&amp</b></body>")], "k int, html string")
    made = markup.blocks(page, "k")
    assert sorted((r["k"], r["text"]) for r in made.collect()) == [(1, "it's &lt so&#3"), (1, "one & two&amp"), (2, "x & y&amp")]
    assert sorted(map(tuple, markup.headings(page, "k").collect())) == [(1, "one & two&amp"), (2, "x & y&amp")]
    spoken = spark.createDataFrame([(1, 0, 0, "one"), (1, 0, 1, "two&amp")], "k int, block_no long, word_no int, word string")
    assert markup.wrap_words(made.where("k = 1 and block_no = 0"), spoken, ["k", "block_no"]).first()["matched"] == 2


def test_removed_markup_reads_a_page_once(spark):
    page = spark.createDataFrame([(1, "<body><p>one <font x=1>two</font> <a href='h' id=k>l</a></p></body>"), (2, "<body>none</body>")], "k int, html string")
    made = markup.removed_markup(page, "k")
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in made.collect()] == [(1, 1, 2)]


def test_word_forms_stay_in_their_rows(spark, sf_dir):
    from taleweave.plans import QUERIES

    assert "Generate" not in QUERIES["t19_word_forms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_archives_come_in_batches_of_bounded_bytes(spark):
    from taleweave.sources import archives

    books = spark.range(48).repartition(1).select(F.col("id").alias("book_id"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("content"))
    most = archives.bounded_batches(books).mapInPandas(lambda frames: (f[["book_id"]].assign(n=len(f)) for f in frames), "book_id long, n long").agg(F.max("n")).first()[0]
    assert most <= 9


def parsed_blocks(source):
    """Blocks of a page by a tree: nodes with parents, built from a parser's events with HTML's implied ends by walking up; the outermost blocks' texts."""
    from html.parser import HTMLParser

    heads = {"h1", "h2", "h3", "h4", "h5", "h6"}
    scope = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"}
    ends_p = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup listing main menu nav ol p pre search section summary table ul hr li dd dt".split()) | heads
    void = set("area base br col embed hr img input link meta source track wbr".split())
    special = ends_p | scope | {"tr", "tbody", "thead", "tfoot", "colgroup", "button", "body"}

    class Node:
        def __init__(self, tag, parent):
            self.tag, self.parent, self.inner = tag, parent, []

        def text(self):
            return "".join(x if isinstance(x, str) else "" if x.tag in ("sup", "script", "style") else x.text() for x in self.inner)

        def outermost(self):
            if self.tag in heads | {"p", "blockquote", "li"}:
                return [(self.tag, " ".join(self.text().split()))]
            return [b for x in self.inner if not isinstance(x, str) for b in x.outermost()]

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = Node("body", None)

        def above(self, names, until):
            node = self.at
            while node.parent and node.tag not in names:
                if node.tag in until:
                    return None
                node = node.parent
            return node if node.tag in names else None

        def leave(self, node):
            if node:
                self.at = node.parent

        def handle_starttag(self, tag, attrs):
            if tag in ("html", "body"):
                return
            if tag in ("li", "dd", "dt"):
                own = {"li"} if tag == "li" else {"dd", "dt"}
                self.leave(self.above(own, special - own - {"address", "div", "p"}))
            if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"):
                if not self.above({"table"}, ()):
                    return
                while self.at.tag not in {"tr": ("table", "tbody", "thead", "tfoot"), "td": ("table", "tbody", "thead", "tfoot", "tr"), "th": ("table", "tbody", "thead", "tfoot", "tr")}.get(tag, ("table",)):
                    self.leave(self.at)
            if tag == "button":
                self.leave(self.above({"button"}, scope))
            if tag in ends_p:
                self.leave(self.above({"p"}, scope | {"button"}))
            phrase = self.at
            while phrase.tag not in special:
                phrase = phrase.parent
            if tag in heads and phrase.tag in heads:
                self.leave(phrase)
            node = Node(tag, self.at)
            self.at.inner.append(node)
            self.at = self.at if tag in void else node

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void and self.at.tag == tag:
                self.leave(self.at)

        def handle_endtag(self, tag):
            if tag in ("html", "body"):
                return
            if tag in heads:
                self.leave(self.above(heads, scope))
            elif tag == "p":
                self.leave(self.above({"p"}, scope | {"button"}))
            elif tag == "li":
                self.leave(self.above({"li"}, scope | {"ol", "ul"}))
            elif tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"):
                self.leave(self.above({tag}, {"table", "html", "template"} - {tag}))
            elif tag in special:
                self.leave(self.above({tag}, scope - {tag}))
            else:
                self.leave(self.above({tag}, special))

        def handle_data(self, data):
            self.at.inner.append(data)

    builder = Builder()
    builder.feed(source)
    builder.close()
    return [(tag, text) for tag, text in builder.root.outermost() if text]


def test_blocks_against_a_tree(spark):
    """Well nested pages, pages of misnested tags of all kinds, and pages whose tags stand in any order."""
    rng = random.Random(4)
    inline = lambda: rng.choice(["plain", "<i>it</i>", "caf&eacute;", "a &amp; b", "&#8212;", "<sup>9</sup>", "x<br>y", "<a href='h'>l</a>", "<!-- no -->"])
    run = lambda: " ".join(inline() for _ in range(rng.randint(0, 4)))
    names = "p p p h1 h2 li li ul ol div div blockquote section dl dd dt table tr td th tbody caption b em span a hr br button object article center pre".split()
    pages = []
    for k in range(400):
        if k < 80:
            parts = [rng.choice([f"<p>{run()}</p>", f"<p>{run()}", f"<h2>{run()}</h2>", f"<h2>{run()}</h3>", f"<blockquote>{run()}<p>{run()}</p></blockquote>", f"<ul><li>{run()}<li>{run()}<p>{run()}</ul>", f"<div>{run()}</div>", f"<table><tr><td>{run()}<p>{run()}<td>{run()}</table>", f"<p/>{run()}", f"<div><blockquote>{run()}</div>{run()}"]) for _ in range(6)]
        else:
            parts = [rng.choice(["<{}>", "<{}>", "</{}>"]).format(rng.choice(names)) + f"w{n} " for n in range(rng.randint(3, 25))]
        pages.append((k, "<body>" + "".join(parts) + "</body>"))
    got = {}
    for r in markup.blocks(spark.createDataFrame(pages, "page int, html string"), "page").orderBy("page", "block_no").collect():
        got.setdefault(r["page"], []).append((r["tag"], r["text"]))
    assert sum(bool(parsed_blocks(source)) for _, source in pages) > 300
    for k, source in pages:
        wanted = parsed_blocks(source)
        if wanted:
            assert got.get(k) == wanted, source


def test_blocks_of_deep_and_long_pages(spark):
    """Time is linear in the tags: deep nests, many open items and stray ends take seconds, and every block is there."""
    n = 30000
    pages = [(1, "<div>" * n + "<p>in" + "<li>x</li>" * n), (2, "<p>a</div></li></h1>" * n), (3, "<ul><li>" * n + "deep"), (4, "<blockquote>all " + "<p>b" * n)]
    began = time.time()
    got = {r["page"]: (r["n"], r["chars"]) for r in markup.blocks(spark.createDataFrame(pages, "page int, html string"), "page").groupBy("page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    assert got == {1: (n + 1, n + 2), 2: (n, n), 3: (1, 4), 4: (1, n + 4)}
    assert time.time() - began < 60


def test_wrapped_words_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["One", "two,", "it's", "Four.", "<i>five</i>", "six"]
    printed = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 8)))) for k in range(60)]
    spoken = [(k, n, w) for k, html in printed for n, w in enumerate(w for w in html.replace("<i>", "").replace("</i>", "").split() if rng.random() < 0.9)]
    got = {r["b"]: r for r in markup.wrap_words(spark.createDataFrame(printed, "b int, html string"), spark.createDataFrame(spoken, "b int, word_no int, word string"), ["b"]).collect()}
    plain = lambda w: "".join(c for c in w.lower() if c.isascii() and (c.isalnum() or c == "'"))
    for k, html in printed:
        heard, at, shown = [plain(w) for b, _, w in spoken if b == k], 0, []
        for word in html.split(" "):
            bare = word.replace("<i>", "").replace("</i>", "")
            if at < len(heard) and plain(bare) == heard[at]:
                shown.append(word.replace(bare, f'<span data-w="{at}">{bare}</span>'))
                at += 1
            else:
                shown.append(word)
        assert (got[k]["matched"], got[k]["spoken"]) == (at, len(heard))
        assert got[k]["html"] == (" ".join(shown) if heard and at >= 0.6 * len(heard) else html)


def test_wrapped_words_read_references_and_marks(spark):
    """References are read and marks match marks; null and unspoken blocks stay; no Python runs; a very long block is read whole."""
    long = " ".join(f"w{k}" for k in range(20000))
    printed = spark.createDataFrame([(1, "caf&eacute; &mdash;&nbsp;so"), (2, None), (3, "not spoken"), (4, long), (5, "x ﷐ y"), (None, "no key")], "b int, html string")
    said = [(1, 0, "café"), (1, 1, "—"), (1, 2, "so"), (2, 0, "two"), (5, 0, "x"), (5, 1, "﷐"), (5, 2, None)] + [(4, k, f"W{k}") for k in range(20000)]
    made = markup.wrap_words(printed, spark.createDataFrame(said, "b int, word_no int, word string"), ["b"])
    got = {r["b"]: (r["html"], r["matched"], r["spoken"]) for r in made.collect()}
    assert got[1] == ('<span data-w="0">caf&eacute;</span> <span data-w="1">&mdash;</span>&nbsp;<span data-w="2">so</span>', 3, 3)
    assert got[2] == (None, 0, 1) and got[3] == ("not spoken", 0, 0) and got[None] == ("no key", 0, 0)
    assert got[4] == (" ".join(f'<span data-w="{k}">w{k}</span>' for k in range(20000)), 20000, 20000)
    assert got[5] == ('<span data-w="0">x</span> <span data-w="1">﷐</span> y', 2, 3)
    assert "Python" not in made._jdf.queryExecution().toString()


def test_wrapped_words_stall_and_gate(spark):
    printed = spark.createDataFrame([(1, "One <i>two</i> three"), (2, "One two three")], "b int, html string")
    spoken = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "zero"), (2, 1, "one")], "b int, word_no int, word string")
    got = {r["b"]: r for r in markup.wrap_words(printed, spoken, ["b"]).collect()}
    assert got[1]["html"] == '<span data-w="0">One</span> <i><span data-w="1">two</span></i> <span data-w="2">three</span>' and got[1]["matched"] == 3
    assert got[2]["html"] == "One two three" and got[2]["matched"] == 0


def _book(title=True):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("OEBPS/c.opf", f'<package xmlns:dc="d"><metadata>{"<dc:title>A Book</dc:title>" if title else ""}<meta name="cover" content="i"/></metadata><manifest><item id="a" href="a.xhtml" media-type="t"/><item id="i" href="img/c.png" properties="cover-image"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", "<html><nav><a href='a.xhtml#x'>Chapter <b>One</b></a></nav></html>")
        z.writestr("OEBPS/a.xhtml", "<p>text</p>")
    return packed.getvalue()


def test_archives(spark, tmp_path):
    for name, content in (("good", _book()), ("bare", _book(False)), ("bad", b"nothing")):
        (tmp_path / f"{name}.epub").write_bytes(content)
    (tmp_path / "other.txt").write_text("x")
    held = archives.read_archives(spark, str(tmp_path))
    verdicts = {r["book_id"]: r["verdict"] for r in archives.judge(archives.listing(held)).collect()}
    assert verdicts == {"good": "accepted", "bare": "accepted", "bad": "not an archive"}
    assert {r["verdict"] for r in archives.judge(archives.listing(held), 10).collect()} == {"too large", "not an archive"}
    parts = archives.members(held)
    books = {r["book_id"]: r for r in archives.packages(parts).collect()}
    assert books["good"]["title"] == "A Book" and books["bare"]["title"] == "bare" and books["good"]["author"] == "Unknown"
    assert books["good"]["manifest"][0]["href"] == "OEBPS/a.xhtml" and books["good"]["spine"][0]["idref"] == "a"
    assert [(r["href"], r["title"]) for r in archives.contents(parts).where("book_id = 'good'").collect()] == [("OEBPS/a.xhtml#x", "Chapter One")]
    stream = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(str(tmp_path)).schema).option("pathGlobFilter", "*.epub").load(str(tmp_path))
    named = stream.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("book_id"), "content")
    landed = streams.drain(archives.listing(named), str(tmp_path / "out"))
    assert landed.where("member is not null").select("book_id").distinct().count() == 2


def test_sidecars_and_presets(spark, tmp_path):
    texts = spark.createDataFrame([(1, '{"duration": 2.0, "chunks": [{"text": "a", "start": 0, "end": 2}]}'), (2, "{ broken"), (3, None)], "id int, value string")
    timed = files.sidecars(texts, ["id"])
    assert [r["timing"] is None for r in timed.orderBy("id").collect()] == [False, True, True]
    assert files.sidecar_chunks(timed, ["id"]).count() == 1
    rows = timed.where("timing is not null").select(F.lit("b").alias("book_id"), F.lit(0).alias("chapter_index"), "timing.*")
    files.write_sidecars(rows, str(tmp_path / "t"))
    files.write_sidecars(rows.withColumn("chapter_index", F.lit(1)), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    sizes = files.storage(spark, str(tmp_path / "t"), "*.json")
    assert sizes.count() == 2 and sizes.agg(F.sum("length")).first()[0] > 0


def test_covers_and_titles(spark):
    row = lambda rows: spark.createDataFrame(rows, "book_id string, ord int, href string")
    images = row([("a", 1, "backcover.jpg"), ("a", 2, "my_cover.jpg"), ("a", 3, "cover.png"), ("b", 1, "x.png")])
    assert [tuple(r) for r in catalog.best_cover(row([]), row([]), row([]), images).collect()] == [("a", "cover.png", 3)]
    docs = spark.createDataFrame([("b", "t/a.html", 1, "x" * 300, None, "H"), ("b", "t/b.html", 2, "First words here. " + "y" * 300, None, None), ("b", "t/c.html", 3, "short", None, None)], "book_id string, href string, n int, text string, x string, heading string")
    toc = spark.createDataFrame([("b", 1, "t/a.html#one", "One"), ("b", 2, "t/a.html", "Later"), ("b", 3, "o/b.html", "Two")], "book_id string, ord int, href string, title string")
    got = catalog.resolve_titles(catalog.with_contents_titles(docs, toc.where("ord < 3")), "n").orderBy("n").collect()
    assert [(r["title"], r["source"], r["index"]) for r in got] == [("One", "toc", 0), ("First words here", "derived", 1)]
    assert [r["toc_title"] for r in catalog.with_contents_titles(docs, toc).orderBy("n").collect()] == ["One", "Two", None]


def test_scans_of_a_hot_book(spark):
    """A book with most rows, a null book and a small one: as one window a book, in ranges of a bounded size."""
    rng = random.Random(4)
    rows = [("hot", c, p, float(rng.randint(1, 9))) for c in range(3) for p in range(400)] + [(b, c, 0, 2.0) for b in (None, "small") for c in range(5)]
    rng.shuffle(rows)
    held = spark.createDataFrame(rows, "book string, chapter int, part int, seconds double")
    wanted, total, count = {}, {}, {}
    for b, c, p, s in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        wanted[b, c, p] = (total.get(b, 0.0), count.get(b, 0))
        total[b], count[b] = total.get(b, 0.0) + s, count.get(b, 0) + 1
    got = scans.numbered(scans.sum_before(held, ["book"], ["chapter", "part"], F.col("seconds"), "start", 64), ["book"], ["chapter", "part"], "no", 64).collect()
    assert len(got) == len(rows) and {(r.book, r.chapter, r.part): (r.start, r.no) for r in got} == wanted
    assert scans._ranged(held, ["book"], ["chapter", "part"], 64).groupBy("_key", "_range").count().agg(F.max("count")).first()[0] <= 64
    # Lookups: each moment with the last span up to it, however many ranges lie between.
    starts = sorted(rng.sample(range(50_000), 300))
    points = [("hot", float(s), 0, s) for s in starts] + [("hot", float(t), 1, None) for t in rng.sample(range(-50, 60_000), 300)] + [("none", 5.0, 1, None)]
    for first in (False, True):
        found = scans.last_before(spark.createDataFrame(points, "book string, t double, kind int, item int"), "book", "t", "kind", "item", "f", 100, first).where("kind = 1").collect()
        assert len(found) == 301
        for r in found:
            assert r.f == (None if r.book == "none" else max((s for s in starts if s <= r.t), default=starts[0] if first else None))


def test_lookups_where_spans_meet(spark):
    """The earlier of two that meet; spans without length and pauses; empty tables."""
    spans = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 5.0, 5.0, "z"), (1, 9000.0, 9010.0, "b"), (1, 9010.0, 9020.0, "c")], "book int, start double, end double, name string")
    moments = spark.createDataFrame([(1, x) for x in (5.0, 7.0, 9010.0, 9015.0, 9021.0)] + [(2, 1.0)], "book int, t double")
    got = {(r.book, r.t): r.name for r in T.span_at(moments, spans, "book", "t", ["name"]).collect()}
    assert got == {(1, 5.0): "a", (1, 7.0): None, (1, 9010.0): "b", (1, 9015.0): "c", (1, 9021.0): None, (2, 1.0): None}
    assert T.as_of(moments.limit(0), spans, "book", "t", ["name"]).count() == 0 and T.as_of(moments, spans.limit(0), "book", "t", ["name"]).count() == 6


@pytest.mark.parametrize("name", ["w02_segment_offsets", "w03_chapter_marks", "s08_timeline_documents", "c02_timeline_faults", "j09_marked_chapters", "j11_segment_at"])
def test_tasks_follow_the_input(spark, sf_dir, monkeypatch, name):
    """However few the session's shuffle partitions, what is made of segments is sorted by as many tasks as its rows need."""
    import re

    from taleweave.operators import partitioning
    from taleweave.plans import QUERIES

    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(partitioning, "ROWS_PER_TASK", -(-n // 37))
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (?:REPARTITION|ENSURE)", plan)
    assert dealt and set(dealt) == {str(-(-n // partitioning.ROWS_PER_TASK))}
