"""The queries of this subpackage, by name, and the SQL that must give the same rows."""

from taleweave.llm import audio, bpe, chat, digest, divergence, langid, license_scan, neardup, packing, periodic, pii, simhash, wrapper


def _table(name):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, conversations = _table("documents"), _table("pages"), _table("conversations")


def op1_chroma_alignment(spark, sf_dir):
    """Recordings derived from documents: each text as a sound of one tone per word, so copies sound alike."""
    return audio.aligned(documents(spark, sf_dir), "doc_id", "text", "text")


def op2_canonical_digest(spark, sf_dir):
    return digest.fingerprint_edits(documents(spark, sf_dir))


def op3_compression_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = langid.predict_language(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_wrapper_induction(spark, sf_dir):
    return wrapper.extract_text(pages(spark, sf_dir))


def op5_chat_layouts(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_turns(chat.canonical_turns(chat.dealt_records(rows))))


def op6_lexicon_bpe(spark, sf_dir):
    docs, vocabulary = documents(spark, sf_dir), bpe.vocabulary_path()
    return bpe.encoding_digests(docs, vocabulary, bpe.ship(spark, bpe.build_lexicon(docs, vocabulary)))


def op7_information_pii(spark, sf_dir):
    return pii.find_pii(documents(spark, sf_dir))


def op8_min_slack_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op9_coordinate_neardup(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(periodic.find_runs(documents(spark, sf_dir), periodic.periodic_tail))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


def op13_simhash_neardup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


_ALL = (op1_chroma_alignment, op2_canonical_digest, op3_compression_langid, op4_wrapper_induction, op5_chat_layouts, op6_lexicon_bpe, op7_information_pii, op8_min_slack_packing, op9_coordinate_neardup, op10_license_scan, op11_periodic_runs, op12_source_divergence, op13_simhash_neardup)
QUERIES = {f.__name__: f for f in _ALL}

#: Exact sets and components by SQL alone, from all pairs that share a shingle.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS shingle FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS g(i) WHERE len(ws) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""

#: Digests of the turns themselves, and lengths of the template with its escapes (runs of # in these texts are of three).
CHAT = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

#: All terms of all groups, dense.
DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
  t AS (SELECT lang, source, term, k, count(*) AS n FROM (SELECT lang, source, k, unnest(ws) AS term FROM d) GROUP BY ALL),
  kept AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
  v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
  c AS (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  g AS (SELECT lang, source FROM d GROUP BY ALL), s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
  p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.total + v.v) AS q
    FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 200"""

ORACLE_SQL: dict[str, str] = {"op5_chat_layouts": CHAT, "op9_coordinate_neardup": NEAR_DUPLICATES, "op12_source_divergence": DIVERGENCE}
