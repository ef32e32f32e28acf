"""Queries of books: `pages` stands for spine documents, `documents` for chapters, `part` and `supplier` for presets and covers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from taleweave.functions import speech as S
from taleweave.operators import catalog, jobs, markup, refresh
from taleweave.operators import timeline as T
from taleweave.plans.registry import BOOK, book_key, query

_EXTRA = '<blockquote>Quoted <p>x <em>y</em>z</p></blockquote><p>n<sup>1</sup>ote <a href="javascript:go()" onclick="x()">here</a> <a href="https://e.org/a">there</a> caf&eacute; &mdash; it&#8217;s &#x2018;so&#x2019; &hellip;</p></article>'


def pages(t):
    """Pages with a quotation, a note mark and two links more."""
    return t("pages").select("page_id", "url", F.replace("html", F.lit("</article>"), F.lit(_EXTRA)).alias("html"))


_BOX = "tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'blockquote', 'li')"
_DECODE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&eacute;', 'é'), '&mdash;', '—'), '&#8217;', '’'), '&#x2018;', '‘'), '&#x2019;', '’'), '&hellip;', '…'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')".replace("chr(160)", "' '")
_INLINE = ", ".join(f"'{x}'" for x in markup.INLINE)
BLOCKS = rf"""WITH d AS (SELECT page_id, url, replace(html, '</article>', '{_EXTRA}') AS html FROM pages),
  n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<sup\b[^>]*>.*?</sup\s*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS html FROM d),
  b AS (SELECT page_id, regexp_replace(html, '(?is)^.*<body\b[^>]*>', '') AS body FROM n),
  s AS (SELECT page_id, string_split(regexp_replace(body, '(<[^>]*>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM b),
  k AS (SELECT page_id, i AS pos, parts[i] AS token FROM s, unnest(generate_series(1, len(parts))) AS g(i) WHERE parts[i] <> ''),
  l AS (SELECT *, CASE WHEN starts_with(token, '<') THEN nullif(lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') END AS tag, starts_with(token, '</') AS closing FROM k),
  u AS (SELECT *, sum(CASE WHEN {_BOX} AND closing THEN -1 WHEN {_BOX} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM l),
  v AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM u),
  w AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY pos), 0) AS was FROM v),
  x AS (SELECT *, CASE WHEN was = 0 AND NOT closing AND (tag = 'p' OR {_BOX}) THEN 1 ELSE 0 END AS opens, CASE WHEN tag = 'p' AND was = 0 THEN (CASE WHEN closing THEN 0 ELSE 1 END) WHEN {_BOX} THEN 0 END AS event FROM w),
  y AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY pos) AS block, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM x),
  z AS (SELECT *, first_value(tag) OVER (PARTITION BY page_id, block ORDER BY pos) AS block_tag FROM y),
  t AS (SELECT *, CASE WHEN tag IS NULL THEN token WHEN tag NOT IN ({_INLINE}) THEN '' WHEN closing THEN '</' || tag || '>'
      WHEN tag = 'a' AND regexp_extract(token, '(?i)\bhref\s*=\s*["'']((?:https?://|#)[^"'']*)["'']', 1) <> '' THEN '<a href="' || regexp_extract(token, '(?i)\bhref\s*=\s*["'']((?:https?://|#)[^"'']*)["'']', 1) || '">' ELSE '<' || tag || '>' END AS shown
    FROM z WHERE (depth > 0 OR p = 1) AND NOT (opens = 1 OR ({_BOX} AND closing AND depth = 0)) AND block > 0),
  m AS (SELECT page_id, block, block_tag, string_agg(CASE WHEN tag IS NULL THEN token ELSE '' END, '' ORDER BY pos) AS raw, string_agg(shown, '' ORDER BY pos) AS html FROM t GROUP BY page_id, block, block_tag),
  e AS (SELECT *, trim(regexp_replace({_DECODE.format("raw")}, '\s+', ' ', 'g')) AS text FROM m),
  blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS block_no, block_tag AS tag, html, text, regexp_matches(html, '(?i)<(em|i|strong|b|a|span|sup|sub|code|small)\b') AS inline FROM e WHERE text <> '')"""


@query("h01_without_noise", rf"{BLOCKS} SELECT page_id, html FROM n")
def h01(t):
    return pages(t).select("page_id", markup.without_noise(F.col("html")).alias("html"))


@query("h02_blocks", f"{BLOCKS} SELECT page_id, block_no, tag, text FROM blocks")
def h02(t):
    return markup.blocks(pages(t), "page_id").select("page_id", "block_no", "tag", "text")


_PLAIN = r"(?i)</?(p|h[1-6]|li|blockquote)\b[^>]*>"


@query(
    "h03_whole_body",
    rf"""WITH d AS (SELECT page_id, regexp_replace(html, '{_PLAIN}', ' ', 'g') AS html FROM pages),
      n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS html FROM d),
      b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)^.*<body\b[^>]*>', ''), '<[^>]*>', '', 'g') AS raw FROM n)
    SELECT page_id, trim(regexp_replace({_DECODE.format("raw")}, '\s+', ' ', 'g')) AS text, 'p' AS tag FROM b""",
)
def h03(t):
    """Every page without its block elements: its whole text is one block."""
    bare = t("pages").select("page_id", F.regexp_replace("html", _PLAIN, " ").alias("html"))
    return markup.blocks(bare, "page_id").select("page_id", "text", "tag")


# Every third page has elements with a telling class in place of its headings.
_STYLED = BLOCKS.replace("AS html FROM pages)", "AS html FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_replace(html, '(?i)<h[1-6]\\b[^>]*>', '<div class=\"page-title\">', 'g'), '(?i)</h[1-6]\\s*>', '</div>', 'g') ELSE html END AS html FROM pages) AS pages)", 1)


@query(
    "h04_headings",
    rf"""{_STYLED}, c AS (SELECT page_id, regexp_extract_all(html, '(?is)<\w+\b[^>]*\bclass\s*=\s*["''][^"'']*(?:head|title|chapter)[^"'']*["''][^>]*>([^<]*)', 1) AS found FROM n),
      r AS (SELECT page_id, i, found[i] AS raw FROM c, unnest(generate_series(1, len(found))) AS g(i)),
      o AS (SELECT page_id, i, trim(regexp_replace({_DECODE.format("raw")}, '\s+', ' ', 'g')) AS text FROM r),
      f AS (SELECT page_id, arg_min(text, i) AS text FROM o WHERE text <> '' AND length(text) <= 100 GROUP BY page_id)
    SELECT page_id, coalesce((SELECT arg_min(text, block_no) FROM blocks b WHERE b.page_id = d.page_id AND regexp_matches(tag, '^h[1-6]$')), (SELECT text FROM f WHERE f.page_id = d.page_id)) AS heading FROM d""",
)
def h04(t):
    held = pages(t)
    styled = F.regexp_replace(F.regexp_replace("html", r"(?i)<h[1-6]\b[^>]*>", '<div class="page-title">'), r"(?i)</h[1-6]\s*>", "</div>")
    return markup.headings(held.withColumn("html", F.when(F.col("page_id") % 3 == 0, styled).otherwise(F.col("html"))), "page_id")


@query("h05_sanitised_blocks", f"{BLOCKS} SELECT page_id, block_no, html FROM blocks")
def h05(t):
    return markup.blocks(pages(t), "page_id").select("page_id", "block_no", "html")


@query(
    "h05_removed_markup",
    f"""{BLOCKS} SELECT page_id, count_if(tag NOT IN ({_INLINE})) AS tags_removed, sum(CASE
      WHEN tag IN ({_INLINE}) THEN len(regexp_extract_all(token, '\\s[A-Za-z:-]+\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s>]+)')) - len(regexp_extract_all(shown, '=\"'))
      ELSE 0 END)::BIGINT AS attributes_removed FROM t WHERE tag IS NOT NULL AND NOT closing GROUP BY page_id""",
)
def h05b(t):
    return markup.removed_markup(pages(t), "page_id")


@query("h06_inline_share", f"{BLOCKS} SELECT page_id, count_if(inline) AS inline, count(*) AS blocks FROM blocks GROUP BY page_id")
def h06(t):
    return markup.blocks(pages(t), "page_id").groupBy("page_id").agg(F.count_if("inline").alias("inline"), F.count("*").alias("blocks"))


_PIECES = r"string_split(regexp_replace(html, '(<[^>]*>|(?:\s|&nbsp;)+)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
_MATCHED = "regexp_replace(lower(replace({}, '’', '''')), '[^0-9a-z'']', '', 'g')"


@query(
    "h07_wrapped_words",
    rf"""{BLOCKS.replace("WITH d AS", "WITH RECURSIVE d AS", 1)},
      pieces AS MATERIALIZED (SELECT page_id, block_no, i - 1 AS i, parts[i] AS piece FROM (SELECT page_id, block_no, {_PIECES} AS parts FROM blocks), unnest(generate_series(1, len(parts))) AS g(i)),
      printed AS MATERIALIZED (SELECT page_id, block_no, i, row_number() OVER (PARTITION BY page_id, block_no ORDER BY i) AS n, {_MATCHED.format(_DECODE.format("piece"))} AS word FROM pieces WHERE i % 2 = 0 AND piece <> ''),
      told AS (SELECT page_id, block_no, i - 1 AS word_no, w[i] AS word FROM (SELECT page_id, block_no, string_split(text, ' ') AS w FROM blocks), unnest(generate_series(1, len(w))) AS g(i)),
      heard AS MATERIALIZED (SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id, block_no ORDER BY word_no) - 1 AS nth, {_MATCHED.format("word")} AS word FROM told WHERE NOT (block_no % 5 = 4 AND word_no = 0)),
      walk AS (SELECT page_id, block_no, 0::BIGINT AS n, 0::BIGINT AS nth, false AS hit FROM blocks
        UNION ALL SELECT p.page_id, p.block_no, p.n, walk.nth + CASE WHEN p.word = h.word THEN 1 ELSE 0 END, coalesce(p.word = h.word, false)
        FROM walk JOIN printed p ON p.page_id = walk.page_id AND p.block_no = walk.block_no AND p.n = walk.n + 1
          LEFT JOIN heard h ON h.page_id = walk.page_id AND h.block_no = walk.block_no AND h.nth = walk.nth),
      marked AS (SELECT p.page_id, p.block_no, p.i, walk.nth - 1 AS nth FROM walk JOIN printed p USING (page_id, block_no, n) WHERE hit),
      shown AS (SELECT page_id, block_no, string_agg(CASE WHEN nth IS NULL THEN piece ELSE '<span data-w="' || nth || '">' || piece || '</span>' END, '' ORDER BY i) AS html, count(nth) AS matched
        FROM pieces LEFT JOIN marked USING (page_id, block_no, i) GROUP BY page_id, block_no),
      lengths AS (SELECT page_id, block_no, count(*) AS spoken FROM heard GROUP BY page_id, block_no)
    SELECT page_id, block_no, CASE WHEN matched > 0 AND matched >= 0.6 * spoken THEN s.html ELSE b.html END AS html, matched, coalesce(spoken, 0) AS spoken
    FROM blocks b JOIN shown s USING (page_id, block_no) LEFT JOIN lengths USING (page_id, block_no)""",
)
def h07(t):
    """Words of each block wrapped where they are spoken; every fifth block's speech lacks its first word, which stalls the pointer."""
    made = markup.blocks(pages(t), "page_id")
    spoken = made.select("page_id", "block_no", F.posexplode(S.words(F.col("text"))).alias("word_no", "word")).where("not (block_no % 5 = 4 and word_no = 0)")
    return markup.wrap_words(made, spoken, ["page_id", "block_no"])


@query("h08_chapter_texts", f"{BLOCKS} SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY page_id")
def h08(t):
    return markup.chapter_text(markup.blocks(pages(t), "page_id"), "page_id")


@query("s03_scan_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def s03(t):
    return t("pages").select("page_id", "url", F.length("html").cast("long").alias("chars"))


_PATH = r"regexp_extract(url, '://[^/]+/([^?#]*)', 1)"
_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_BOOKS = rf"""d AS (SELECT page_id % 10 AS book_id, page_id AS spine_no, {_PATH} AS href, {_TITLE} AS title FROM pages),
  toc AS (SELECT book_id, spine_no AS ord, CASE WHEN spine_no % 3 = 1 THEN href || '#top' ELSE 'x/' || regexp_extract(href, '([^/]*)$', 1) END AS href, title FROM d WHERE spine_no % 3 <> 0),
  exact AS (SELECT book_id, regexp_replace(href, '#.*$', '') AS href, arg_min(title, ord) AS title, min(ord) AS ord FROM toc WHERE href <> '' AND title <> '' GROUP BY 1, 2),
  byname AS (SELECT book_id, regexp_extract(href, '([^/]*)$', 1) AS base, arg_min(title, ord) AS title FROM exact GROUP BY 1, 2)"""


def book_pages(t):
    path, title = F.regexp_extract("url", r"://[^/]+/([^?#]*)", 1), F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return t("pages").select((F.col("page_id") % 10).alias("book_id"), F.col("page_id").alias("spine_no"), path.alias("href"), title.alias("title"), "html", "page_id")


def toc(t):
    link = F.when(F.col("spine_no") % 3 == 1, F.concat("href", F.lit("#top"))).otherwise(F.concat(F.lit("x/"), S.base_name(F.col("href"))))
    return book_pages(t).where("spine_no % 3 <> 0").select("book_id", F.col("spine_no").alias("ord"), link.alias("href"), "title")


@query("j01_spine_documents", f"WITH {_BOOKS} SELECT book_id, spine_no, href FROM d WHERE spine_no % 7 <> 0 AND spine_no % 11 <> 0")
def j01(t):
    held = book_pages(t)
    name = F.concat(F.lit("item"), F.col("spine_no").cast("string"))
    manifest = held.where("spine_no % 7 <> 0").select("book_id", name.alias("idref"), F.concat("href", F.lit("|"), name).alias("href"))
    documents = held.where("spine_no % 11 <> 0").select("book_id", F.concat("href", F.lit("|"), name).alias("href"))
    found = catalog.spine_documents(held.select("book_id", "spine_no", name.alias("idref")), manifest, documents)
    return found.select("book_id", "spine_no", F.substring_index("href", "|", 1).alias("href"))


@query("j02_contents_titles", f"WITH {_BOOKS} SELECT book_id, href, trim(title) AS title FROM exact")
def j02(t):
    return catalog.contents_titles(toc(t)).select("book_id", "href", "title")


@query(
    "j03_titles_by_name",
    f"""WITH {_BOOKS} SELECT d.book_id, d.spine_no, coalesce(trim(e.title), trim(b.title)) AS toc_title FROM d LEFT JOIN exact e ON e.book_id = d.book_id
      AND e.href = d.href LEFT JOIN byname b ON b.book_id = d.book_id AND b.base = regexp_extract(d.href, '([^/]*)$', 1)""",
)
def j03(t):
    return catalog.with_contents_titles(book_pages(t).select("book_id", "spine_no", "href"), toc(t)).select("book_id", "spine_no", "toc_title")


_CHAPTERS = rf"""d AS (SELECT {BOOK} AS book_id, doc_id, text, CASE WHEN doc_id % 4 = 1 THEN 'Contents ' || doc_id WHEN doc_id % 4 = 2 THEN '' END AS toc_title, CASE WHEN doc_id % 3 = 0 THEN 'Heading ' || doc_id END AS heading FROM documents WHERE length(text) >= 200),
  s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) - 1 AS index, regexp_replace(regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?s)^(.*?(?:[.!?]\s|$))', 1), '\s+$', '') AS first FROM d),
  c AS (SELECT book_id, doc_id, index, CASE WHEN toc_title <> '' THEN toc_title WHEN heading <> '' THEN heading WHEN first <> '' THEN regexp_replace(CASE WHEN length(first) > 60 THEN (CASE WHEN contains(first[1:60], ' ') THEN regexp_replace(first[1:60], '(?s) [^ ]*$', '') ELSE first[1:60] END) || '…' ELSE first END, '\.+$', '') ELSE 'Section ' || (index + 1) END AS title,
    CASE WHEN toc_title <> '' THEN 'toc' WHEN heading <> '' THEN 'heading' WHEN first <> '' THEN 'derived' ELSE 'generic' END AS source FROM s)"""


def chapters(t):
    i = F.col("doc_id")
    held = t("documents").select(book_key("book_id"), "doc_id", "text", F.when(i % 4 == 1, F.concat(F.lit("Contents "), i.cast("string"))).when(i % 4 == 2, "").alias("toc_title"), F.when(i % 3 == 0, F.concat(F.lit("Heading "), i.cast("string"))).alias("heading"))
    return catalog.resolve_titles(held, "doc_id")


_FRONT = f"regexp_matches(title, '{S.FRONT_MATTER}')"


@query("j04_resolved_titles", f"WITH {_CHAPTERS} SELECT book_id, doc_id, index, title, source, {_FRONT} AS front_matter FROM c")
def j04(t):
    return chapters(t).select("book_id", "doc_id", "index", "title", "source", "front_matter")


_BARE = "(SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN repeat(' ', length(text)) ELSE text END AS text) FROM documents)"
_GENERIC = _CHAPTERS.replace("FROM documents", f"FROM {_BARE}").replace("doc_id % 4 = 1", "false").replace("doc_id % 4 = 2", "false").replace("doc_id % 3 = 0", "false")


@query("w11_generic_titles", f"WITH {_GENERIC} SELECT book_id, doc_id, title, source FROM c")
def w11(t):
    """A quarter of the chapters have no word: they are titled by their numbers among all."""
    none = F.lit(None).cast("string")
    text = F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit(" "), F.length("text"))).otherwise(F.col("text"))
    held = t("documents").select(book_key("book_id"), "doc_id", text.alias("text"), none.alias("toc_title"), none.alias("heading"))
    return catalog.resolve_titles(held, "doc_id").select("book_id", "doc_id", "title", "source")


_PLAN = "p AS (SELECT doc_id, quality = 1 AS include, CASE WHEN toxic = 1 THEN 'Renamed ' || doc_id ELSE ' ' END AS title FROM labels)"


def plan(t):
    return t("labels").select("doc_id", (F.col("quality") == 1).alias("include"), F.when(F.col("toxic") == 1, F.concat(F.lit("Renamed "), F.col("doc_id").cast("string"))).otherwise(" ").alias("title"))


@query("j05_applied_plan", f"WITH {_PLAN}, k AS (SELECT {BOOK} AS book, d.doc_id, CASE WHEN trim(p.title) <> '' THEN p.title ELSE 'T' || d.doc_id END AS title FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id WHERE coalesce(p.include, true)) SELECT book, doc_id, title, row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS position FROM k".replace("(doc_id // 1000)", "(d.doc_id // 1000)"))
def j05(t):
    held = t("documents").select(book_key(), "doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))
    entries = plan(t).join(held.select("book", "doc_id"), "doc_id")
    return catalog.apply_plan(held, entries, ["book", "doc_id"]).select("book", "doc_id", "title", "position")


@query("w01_positions", f"WITH {_PLAN}, k AS (SELECT d.doc_id, {BOOK} AS book, p.include FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id) SELECT book, doc_id, row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS position FROM k WHERE coalesce(include, true)".replace("(doc_id // 1000)", "(d.doc_id // 1000)"))
def w01(t):
    held = t("documents").select(book_key(), "doc_id").join(plan(t).select("doc_id", "include"), "doc_id", "left")
    return T.positions(held, "book", "doc_id", "include").select("book", "doc_id", "position")


_RECORDED = "r AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id FROM p WHERE include)"


@query(
    "j06_plan_changes",
    f"""WITH {_PLAN}, {_RECORDED} SELECT doc_id, 'narrate' AS change FROM i WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT doc_id, 'dropped'
      FROM r WHERE doc_id NOT IN (SELECT doc_id FROM i)""",
)
def j06(t):
    return catalog.plan_changes(t("documents").where("doc_id % 3 <> 0").select("doc_id"), plan(t), ["doc_id"])


@query(
    "u02_recorded_sets",
    f"""WITH {_PLAN}, {_RECORDED} SELECT doc_id, 'new' AS side FROM (SELECT doc_id FROM i EXCEPT SELECT doc_id FROM r) UNION ALL SELECT doc_id, 'kept'
      FROM (SELECT doc_id FROM r INTERSECT SELECT doc_id FROM i)""",
)
def u02(t):
    recorded, included = t("documents").where("doc_id % 3 <> 0").select("doc_id"), plan(t).where("include").select("doc_id")
    return included.subtract(recorded).withColumn("side", F.lit("new")).unionByName(recorded.intersect(included).withColumn("side", F.lit("kept")))


_COVERS = """SELECT p_partkey % 40 AS book_id, p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'img/cover.jpg' WHEN 1 THEN 'img/Cover-2.png' WHEN 2 THEN 'img/backcover.jpg' WHEN 3 THEN 'img/the_cover.jpg' ELSE 'img/p' || p_partkey || '.png' END AS href FROM part"""


@query(
    "j14_covers",
    f"""WITH im AS ({_COVERS}), c AS (SELECT book_id, ord, href, 0 AS rank FROM im WHERE ord % 60 = 7 UNION ALL SELECT book_id, ord, href, 1 FROM im WHERE ord % 50 = 9 UNION ALL SELECT book_id, ord, href, 2 FROM im WHERE ord % 45 = 11
      UNION ALL SELECT book_id, ord, href, CASE WHEN href = 'img/cover.jpg' THEN 3 WHEN starts_with(href, 'img/Cover') THEN 4 ELSE 5 END FROM im WHERE contains(lower(href), 'cover') AND NOT contains(href, 'back'))
    SELECT book_id, href, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY rank, ord, href) AS n FROM c) WHERE n = 1""",
)
def j14(t):
    k = F.col("p_partkey")
    names = F.when(k % 6 == 0, "img/cover.jpg").when(k % 6 == 1, "img/Cover-2.png").when(k % 6 == 2, "img/backcover.jpg").when(k % 6 == 3, "img/the_cover.jpg").otherwise(F.concat(F.lit("img/p"), k.cast("string"), F.lit(".png")))
    images = t("part").select((k % 40).alias("book_id"), k.alias("ord"), names.alias("href"))
    return catalog.best_cover(images.where("ord % 60 = 7"), images.where("ord % 50 = 9"), images.where("ord % 45 = 11"), images)


_PRESETS = "p AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier)"


def presets(t):
    return t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))


@query(
    "j15_job_presets",
    f"""WITH {_PRESETS}, j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'custom' ELSE (o_orderkey % 200)::VARCHAR END AS narrator
      FROM orders) SELECT j.id, narrator, p.name, p.name IS NOT NULL OR narrator = 'custom' AS found FROM j LEFT JOIN p ON p.id = narrator""",
)
def j15(t):
    k = F.col("o_orderkey")
    held = t("orders").select(k.alias("id"), F.when(k % 9 == 0, "custom").otherwise((k % 200).cast("string")).alias("narrator"))
    return catalog.with_presets(held, presets(t), "narrator").select("id", "narrator", "name", "found")


@query("j18_preview_coverage", f"WITH {_PRESETS} SELECT id, name, id::BIGINT % 3 = 0 AS has_preview FROM p")
def j18(t):
    held = presets(t)
    return catalog.preview_coverage(held, held.where("cast(id as long) % 3 = 0").select("id"))


@query(
    "s15_preset_upsert",
    f"""WITH {_PRESETS} SELECT id, CASE WHEN id::BIGINT % 4 = 0 THEN 'New ' || id ELSE name END AS name FROM p UNION ALL SELECT 'x' || id, 'New x' FROM p
      WHERE id::BIGINT % 10 = 0""",
)
def s15(t):
    held = presets(t)
    new = held.where("cast(id as long) % 4 = 0").select("id", F.concat(F.lit("New "), "id").alias("name")).unionByName(held.where("cast(id as long) % 10 = 0").select(F.concat(F.lit("x"), "id").alias("id"), F.lit("New x").alias("name")))
    return catalog.upsert(held, new)


@query("u01_preset_union", f"WITH {_PRESETS} SELECT id, 'built-in ' || name AS name FROM p WHERE id::BIGINT % 2 = 0 UNION ALL SELECT id, name FROM p WHERE id::BIGINT % 2 <> 0")
def u01(t):
    held = presets(t)
    return catalog.prefer_first(held.where("cast(id as long) % 2 = 0").withColumn("name", F.concat(F.lit("built-in "), "name")), held, "id")


@query("u03_text_sources", "SELECT doc_id AS id, 'documents' AS origin, text FROM documents UNION ALL SELECT item_id, 'benchmark', text FROM benchmark")
def u03(t):
    both = t("documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "text")
    return both.unionByName(t("benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), "text"))


@query("s10_missing_items", "SELECT item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def s10(t):
    return refresh.append_missing(t("benchmark").select(F.col("item_id").alias("id")), t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), ["id"])


@query("s11_evolved_rows", "SELECT c_custkey AS id, 'full' AS mode, 0 AS revision, NULL::VARCHAR AS segment FROM customer UNION ALL SELECT s_suppkey, 'sample', 3, 'S' FROM supplier")
def s11(t):
    old = t("customer").select(F.col("c_custkey").alias("id"))
    new = t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("sample").alias("mode"), F.lit(3).alias("revision"), F.lit("S").alias("segment"))
    return catalog.evolve(old, new, {"mode": "full", "revision": 0})
