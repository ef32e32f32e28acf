"""Periodic runs, the source audit and SimHash against brute force, with odd rows, hot keys and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.llm import divergence, periodic, simhash
from taleweave.llm.queries import op11_periodic_runs, op12_source_divergence, op13_simhash_neardup

SCHEMA = "doc_id long, text string, lang string, source string, term string, id long, block int, code long, runs string, tile int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, ties, repeated rows, null ids, null groups, one very long text, columns with clashing names."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(4000)}" for _ in range(60_000)]
    texts = [None, "", " \t\n ", "one", "one two", "One TWO  three", "na " * 40, "é x " * 9, "a b " * 30 + "c", " ".join(words), " ".join(words[:50] * 30), "x" * 40_000, "日本 語 " * 8]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", "t", 1, 2, 3, "r", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[6], rows[9], (None, "na " * 40, "en", "s1", None, None, None, None, None, None), (None,) * 10], SCHEMA)


def save(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


QUERIES = (op11_periodic_runs, op12_source_divergence, op13_simhash_neardup)


@pytest.mark.parametrize("query", QUERIES)
def test_empty_table(spark, odd, tmp_path, query):
    assert query(spark, save(odd.limit(0), tmp_path)).count() == 0


# 11
def all_runs(w):
    """Every run by definition: for each period the stretches of equal words that far apart, kept if no smaller period fits."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                found.append((i, n, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row_of_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(v for i, v in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(600):
        letters, w = rng.choice([1, 2, 3, 5, 30]), []
        while len(w) < rng.randint(0, 120):
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
            w += (part * rng.randint(2, 9))[: rng.randint(2, 200)] if rng.random() < 0.4 else part
        assert periodic.runs(w) == all_runs(w)
        text, beside = " ".join(map(str, w)).encode(), b" ".join(b"%d" % rng.randrange(3) for _ in range(rng.randint(0, 30)))
        found = periodic.runs_of_texts([beside, text, b"", beside])
        assert [f for _, f in found] == [all_runs(beside.split()), all_runs(w), [], all_runs(beside.split())]


def test_squares_have_the_most_recent_end():
    """What a path's segments say, against all suffixes of all prefixes."""
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        got = {(i, d): n for i, d, n in periodic.repeats(w)}
        want = {}
        for i in range(len(w)):
            for n in range(1, i + 1):
                ends = [e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]]
                if ends:
                    want[i, i - ends[-1]] = n
        assert got == {k: n for k, n in want.items() if n >= k[1]}


def test_runs_query_against_brute_force(spark, sf_dir, odd, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.where(F.length("text") < 6000).select("doc_id", "text").collect()  # brute force is quadratic; the query reads all
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == docs.count() and len(short) > 100
    for r in short:
        assert got[r["doc_id"]] == row_of_runs(r["doc_id"], r["text"])
    assert sum(v[1] > 0 for v in got.values()) >= 5
    rows = op11_periodic_runs(spark, save(odd, tmp_path)).select(COLUMNS).collect()
    wanted = [row_of_runs(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (9, 10)]
    assert Counter(tuple(r) for r in rows if r["doc_id"] not in (9, 10)) == Counter(wanted)
    assert sum(r["doc_id"] == 9 for r in rows) == 2


def test_long_runs_are_whole():
    unit = [b"u%d" % i for i in range(5000)]
    (_, found), = periodic.runs_of_texts([b" ".join([b"before", *unit * 4, b"after"])])
    assert found == [(1, 20_000, 5000)]
    (_, found), = periodic.runs_of_texts([b" ".join([b"before", *(unit * 4)[:-1], b"after"])])
    assert found == []
    (words, found), = periodic.runs_of_texts([b"ha " * 200_000])
    assert found == [(0, 200_000, 1)] and periodic.without_repeats(words, found) == [b"ha"]


# 12
def audited(rows, least=3, ranks=200):
    """(lang, source, part, item, value, rank) by definition, with Python's integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for ws, (_, lang, source) in zip(terms, rows):
        seen[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in counts if g == lang]

        def price(of):
            whole = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (of[t] + 1) // whole for t in kept}

        p = {s: price(counts[lang, s]) for s in sources}
        q = price(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            telling = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", telling, ranks)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return out


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def test_audit_of_odd_rows(spark, odd, tmp_path):
    got = [tuple(r[c] for c in AUDIT) for r in op12_source_divergence(spark, save(odd, tmp_path)).collect()]
    assert sorted(got) == sorted(audited([(r["text"], r["lang"], r["source"]) for r in odd.collect()]))


def test_audit_in_many_blocks_and_tiles(spark, monkeypatch):
    """Small blocks and tiles, many sources, one of which holds a third of the rows, and one language without kept terms."""
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "HELD", 40)
    rng = random.Random(3)
    names = ["hot"] * 60 + [f"s{i}" for i in range(11)] * 11
    rows = [(" ".join(rng.choice(["ab", "Cd", "é", "ü", "x" + "abcdefgh"[rng.randrange(8)], "y" + "abcdefghijkl"[rng.randrange(12)]]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de"]), s) for s in names]
    rows += [(f"rare{'abcdefgh'[i]}", "xx", f"s{i}") for i in range(4)] + [("", "yy", "only")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), ranks=5)
    assert sorted(tuple(r) for r in got.select(AUDIT).collect()) == sorted(audited(rows, ranks=5))


def test_prices_of_huge_counts():
    whole = 9 * 10**15
    counts = [0, 1, 10**9, 10**13 + 7, whole - 2]
    assert divergence.prices(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts]


def test_galloping():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 2000), rng.integers(0, 400))) for _ in range(2))
        i, j = divergence.gallop(a, b, chunk=int(rng.integers(1, 9)))
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


# 13
def xxh64(data: bytes, seed: int) -> int:
    """XXH64 by its published description."""
    m, p1, p2, p3, p4, p5 = 2**64 - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda v, n: (v << n | v >> 64 - n) & m
    step = lambda acc, v: turn(acc + v * p2 & m, 31) * p1 & m
    at, n = 0, len(data)
    if n >= 32:
        v = [seed + p1 + p2 & m, seed + p2 & m, seed, seed - p1 & m]
        while at <= n - 32:
            v = [step(x, int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little")) for k, x in enumerate(v)]
            at += 32
        h = turn(v[0], 1) + turn(v[1], 7) + turn(v[2], 12) + turn(v[3], 18) & m
        for x in v:
            h = (h ^ step(0, x)) * p1 + p4 & m
    else:
        h = seed + p5 & m
    h = h + n & m
    while at + 8 <= n:
        h = turn(h ^ step(0, int.from_bytes(data[at : at + 8], "little")), 27) * p1 + p4 & m
        at += 8
    if at + 4 <= n:
        h = turn(h ^ int.from_bytes(data[at : at + 4], "little") * p1 & m, 23) * p2 + p3 & m
        at += 4
    for byte in data[at:]:
        h = turn(h ^ byte * p5 & m, 11) * p1 & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    return h ^ h >> 32


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, sf_dir, odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = [f"v{i}" for i in range(400)]
    rows += [(10_000 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 400, 8)] + [(9_000, None), (9_001, "  "), (9_002, "a b")]
    folder = save(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path / "a")
    codes = {i: fingerprint(t) for i, t in rows}
    near = [(a, b) for a in codes for b in codes if a < b and (codes[a] ^ codes[b]).bit_count() <= 2]
    want = least_reachable(codes, near)
    got = {r["doc_id"]: r for r in op13_simhash_neardup(spark, folder).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{c:016x}" for i, c in codes.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want and any((codes[a] ^ codes[b]).bit_count() == 2 for a, b in near)
    rows = op13_simhash_neardup(spark, save(odd, tmp_path / "b")).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((r["doc_id"], f"{fingerprint(r['text']):016x}") for r in odd.collect())
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in rows)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "red green blue black"), (5, "one two three four"), (5, "red green blue black"), (7, "one two three four"), (9, "other words than these"), (5, "five six seven eight"), (8, "five six seven eight")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (8, 1), (9, 9)}


@pytest.mark.parametrize("hot", [1, 5, 100_000])
def test_links_of_hot_segments(spark, monkeypatch, hot):
    """Many fingerprints that share a segment, or lie a bit beside a shared one, at several thresholds of what is hot."""
    monkeypatch.setattr(simhash, "HOT_SEGMENT", hot)
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            code = centre
            for _ in range(rng.randrange(6)):
                code ^= 1 << rng.randrange(*rng.choice([(0, 32), (32, 64), (0, 6), (60, 64)]))
            codes.add(code)
    signed = {c - 2**64 if c >> 63 else c: c for c in codes}
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(c,) for c in signed], "code long")).collect()]
    assert all(a != b and (signed[a] ^ signed[b]).bit_count() <= 2 for a, b in got)
    true = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2]
    assert len(true) > 300 and least_reachable(signed, got) == least_reachable(signed, true)
    if hot == 100_000:
        assert {tuple(sorted(p)) for p in got} == set(true)
