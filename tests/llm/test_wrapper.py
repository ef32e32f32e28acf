"""Operator 4: main text of pages by wrapper induction."""

import html as entities
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taleweave.llm import wrapper

SCHEMA = "page_id long, url string, html string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def by_id(df, key="page_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><a>Site</a></header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>Accept</div><article><h1>T{i} &amp; x</h1><p>Common promise of ours</p><p>Body {i}  <b>bold<br>{i}<p>More&nbsp;{i}</p><form><input></form><div class='comments'><p>nice</div></article><aside>{i}</aside><footer>&copy; {i}</footer></body>"


def test_main_text_and_template(spark):
    rows = [(i, "https://a.example.org/p?x=1", PAGE.replace("{i}", str(i))) for i in range(8)] + [(20, "http://b.example.org/", PAGE.replace("{i}", "20")), (21, None, None), (22, "x", ""), (23, "x", "<p>plain <script>if (a<b) {}</script>text<!-- open")]
    got = by_id(wrapper.extract_text(spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1))))
    for i in range(8):
        assert got[i]["text"] == f"T{i} & x\nBody {i} bold {i}\nMore {i}"
    assert got[20]["text"].split("\n") == ["T20 & x", "Common promise of ours", "Body 20 bold 20", "More 20"]  # alone on its host
    assert (got[21]["text"], got[22]["text"], got[23]["text"]) == ("", "", "plain text") and got[20]["n_chars"] == len(got[20]["text"])


def test_extraction_against_reference(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = by_id(wrapper.extract_text(pages))
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|article)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)


def test_a_notice_among_many_paragraphs_is_template(spark):
    page = lambda k: "<body><article>" + "".join(f"<p>{words(1000 * k + j, 9)}</p>" for j in range(12)) + "<p>Read our notice on every page.</p></article></body>"
    got = by_id(wrapper.extract_text(spark.createDataFrame([(k, "http://long.example/", page(k)) for k in range(200)], SCHEMA).coalesce(2)))
    assert all("notice" not in r["text"] and r["text"].count("\n") == 11 for r in got.values())


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><article><h1>Title</h1>" + "".join(f"<p>{words(j, 9)}</p>" for j in range(4)) + "</article></body>"
    other = lambda k: f"<body><article><h1>Other {k}</h1><p>{words(50 + k, 9)}</p></article></body>"
    rows = [(k, "http://a.example/", copy) for k in range(6)] + [(10 + k, "http://b.example/", copy if k < 5 else other(k)) for k in range(8)]
    got = by_id(wrapper.extract_text(spark.createDataFrame(rows, SCHEMA)))
    assert all(got[k]["text"].split("\n") == ["Title", *(words(j, 9) for j in range(4))] for k in [*range(6), *range(10, 15)])
    assert got[16]["text"].startswith("Other 6\n")


def test_constants_empty_no_page(spark):
    rows = [(k, "http://c.example/", f"<body><p>Same notice.</p>{f'<p>{words(k, 9)}</p>' if k else ''}</body>") for k in range(9)]
    got = by_id(wrapper.extract_text(spark.createDataFrame(rows, SCHEMA)))
    assert got[0]["text"] == "Same notice." and got[1]["text"] == words(1, 9)


def article_of(source):
    """What stands in the article element of the test tables' pages, read by hand."""
    body = source[source.index("<article>") : source.index("</article>")]
    blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|article)>", body)]
    return "\n".join(b for b in blocks if b)


def nameless(source):
    """The page with every name that could tell what an element is taken out."""
    source = re.sub(r"<(/?)(?:nav|article|footer|ul|li)>", r"<\1div>", source)
    return source.replace('<div class="ad">', "<div>")


@pytest.fixture(scope="module")
def many_pages(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet").cache()


def test_pages_without_names_are_read_by_their_template(spark, many_pages):
    rows = [(r["page_id"], r["url"], r["html"]) for r in many_pages.collect()]
    sizes = Counter(host for host, _ in {(re.search("//([^/]+)", u)[1], article_of(h)) for _, u, h in rows})
    held = spark.createDataFrame([(i, u, nameless(h)) for i, u, h in rows if sizes[re.search("//([^/]+)", u)[1]] >= wrapper.FEW], SCHEMA)
    with_it, without = by_id(wrapper.extract_text(held)), by_id(wrapper.extract_text(held, induce=False))
    true = {i: article_of(h) for i, _, h in rows if i in with_it}
    right = sum(with_it[i]["text"] == true[i] for i in true)
    assert len(true) > 100 and right >= 0.9 * len(true) and sum(without[i]["text"] == true[i] for i in true) == 0


def test_hosts_of_the_test_table_have_a_content_root(many_pages):
    """Menus, adverts and footers of these pages change from page to page, so their places are told from the article's by where text varies most."""
    known = wrapper.induced(wrapper.stored(wrapper.read_pages(many_pages)))
    found = {r["host"]: len(r["inside"]) for r in known.collect()}
    assert len(found) >= 20 and sum(n == 3 for n in found.values()) >= 0.9 * len(found)  # article, h1 and p, without what stands beside


def test_induction_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        host = f"h{k % 4}.example"
        parts = [f"<div class='x'><p>{rng.choice(['stay tuned', 'read on'])}</p></div>"] * rng.randint(0, 1)
        parts += ["<div><p>same of " + host + "</p></div>"] * (rng.random() < 0.8)
        parts += ["<section>" + "".join(f"<p>{words(100 * k + j, 6)}</p>" for j in range(rng.randint(1, 4))) + "</section>"]
        parts += [f"<ul><li>{words(rng.randint(0, 3), 2)}</li><li>end</li></ul>"] * (rng.random() < 0.7)
        rows.append((k, f"http://{host}/{k}", "<body>" + "".join(parts) + "</body>"))
    pages = {i: (u, wrapper.Page(h)) for i, u, h in rows}
    trees = defaultdict(Counter)
    held = {}
    for i, (u, page) in pages.items():
        blocks = page.flagged()
        host = u.split("/")[2]
        held.setdefault((host, tuple(t for _, t, f in blocks if f & wrapper.NAMED)), []).append((page.shape, blocks))
    import xxhash

    digest = lambda shape: xxhash.xxh3_128_hexdigest(shape)
    for (host, _), same in held.items():
        trees[host][min(digest(s) for s, _ in same)] += 1
    shapes = {digest(p.shape): p.shape for _, p in pages.values()}
    wanted = Counter()
    for host, found in trees.items():
        template = min(found, key=lambda t: (-found[t], t))
        own, pages_at, counts = {}, Counter(), Counter()
        for t, n in found.items():
            ids = {}
            own[t] = wrapper.simple_match(wrapper.Tree(shapes[t], ids), wrapper.Tree(shapes[template], ids))[1]
            pages_at.update({o: n for o in own[t] if o >= 0})
        for (h, _), same in held.items():
            if h == host:
                shape, blocks = min(same, key=lambda x: digest(x[0]))
                counts.update({(own[digest(shape)][n], t) for n, t, _ in blocks if own[digest(shape)][n] >= 0})
        for (o, t), n in counts.items():
            wanted[host, o, t] = (n, pages_at[o] >= wrapper.FEW and n >= wrapper.CONSTANT * pages_at[o])
    read = wrapper.stored(wrapper.read_pages(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    distinct = wrapper.stored(wrapper.distinct_pages(read))
    got = {(r["host"], r["own"], r["key"]): (r["n"], r["constant"]) for r in wrapper.text_counts(distinct, wrapper.stored(wrapper.aligned_trees(read, distinct))).collect()}
    assert got == {(h, o, xxhash.xxh3_64_intdigest(t, seed=0) - 2**63): v for (h, o, t), v in wanted.items()} and sum(c for _, c in got.values()) >= 4


def brute_match(a, b):
    """Nodes in the largest order-preserving match of two nested (kind, children) trees."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), brute_match(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def test_simple_matching_against_brute_force():
    rng = random.Random(3)

    def tree(depth):
        return rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)]

    shape = lambda t: f"({t[0]}{''.join(map(shape, t[1]))})"
    for _ in range(300):
        x, y = ("#", [tree(2) for _ in range(3)]), ("#", [tree(2) for _ in range(3)])
        ids = {}
        a, b = wrapper.Tree(shape(x), ids), wrapper.Tree(shape(y), ids)
        score, own = wrapper.simple_match(a, b)
        pairs = [(i, o) for i, o in enumerate(own) if o >= 0]
        assert score == brute_match(x, y) == len(pairs) and [o for _, o in pairs] == sorted({o for _, o in pairs})
        assert all(a.sigs[i] == b.sigs[o] and (i == 0 or own[a.parents[i]] == b.parents[o]) for i, o in pairs)


def test_deep_long_and_broken_pages(spark):
    rows = [(1, "http://d/", "<div>" * 5000 + "deep" + "</div>" * 5000), (2, "http://d/", "<a " * 350_000), (3, "http://d/", "<div>" * 4000 + "other"), (4, "http://d/", "<p>" + "long " * 300_000), (5, "http://d/", "x <p title='a>b'>q</p> 1 < 2"), (6, "http://d/", '<p "> a " <a "> b " <a>')]
    began = time.time()
    got = by_id(wrapper.extract_text(spark.createDataFrame(rows, SCHEMA)))
    assert time.time() - began < 60
    assert got[1]["text"] == "deep" and got[3]["text"] == "other" and got[4]["n_chars"] == 5 * 300_000 - 1 and got[5]["text"] == "x\nq\n1 < 2"


def test_a_paragraph_of_every_page_is_template(spark):
    """Each of 50 pages has 20 paragraphs of its own and one that all have."""
    page = lambda k: "<body><article>" + "".join(f"<p>{words(100 * k + j, 9)}</p>" for j in range(20)) + "<p>Common to all.</p></article></body>"
    got = by_id(wrapper.extract_text(spark.createDataFrame([(k, "http://fifty.example/", page(k)) for k in range(50)], SCHEMA)))
    assert all("Common" not in r["text"] and r["text"].count("\n") == 19 for r in got.values())


def test_comments_and_related_links_of_div_pages(spark):
    """Neither varies less than the article; the comments' names and the links' shares tell them apart."""
    def page(k):
        links = "".join(f"<div><a href='/{k}{j}'>{words(9000 + 10 * k + j, 3)}</a></div>" for j in range(3))
        return (
            f"<div><div><a>Home</a></div><div><h1>Head {k}</h1><p>{words(k, 60)}</p><p>{words(300 + k, 50)}</p><div class='comments'><p>{words(600 + k, 12)}</p></div></div>"
            f"<section>{links}</section><div><p>All rights</p></div></div>"
        )

    got = by_id(wrapper.extract_text(spark.createDataFrame([(k, "http://e.example/x", page(k)) for k in range(12)], SCHEMA)))
    assert all(got[k]["text"] == f"Head {k}\n{words(k, 60)}\n{words(300 + k, 50)}" for k in range(12))


def test_empty_table_odd_rows_and_clashing_columns(spark):
    rows = [(None, None, None), (1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (2, "", ""), (None, "http://a/", "<p>y")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("host", "text", "n_chars", "tree", "inside", "blocks", "own", "key")})
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in wrapper.extract_text(pages).collect())
    assert got == [(0, "", "", 0), (0, "http://a/", "y", 1), (1, "http://a/", "x", 1), (1, "http://a/", "x", 1), (2, "", "", 0)]
    none = wrapper.extract_text(pages.limit(0))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]
