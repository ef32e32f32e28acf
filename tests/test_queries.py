"""Every query against its SQL twin in DuckDB, over whole small tables."""

import duckdb
import pytest

from taleweave.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    rows = sorted(tuple(canonical(r[i]) for i in order) for r in found.collect())
    if name not in SQL:
        assert rows
        return
    wanted = duck.execute(SQL[name])
    names = [c[0] for c in wanted.description]
    place = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(found.columns) == sorted(names)
    assert rows == sorted(tuple(canonical(r[i]) for i in place) for r in wanted.fetchall())


#: A list marker after a break that is none: after an initial, an abbreviation, another marker, before lower case; one that begins a sentence; and none.
MARKED = ["J. ii. Foo bar. Next one.", "He met Dr. iv. Then he left. It was late.", "1. 2. Foo bar.", "ciónosción. Ll. De que ra. Adota el.", "vivi. vivi. De la mora.", "3. Item here. Other. He was born in 1985. Later."]


@pytest.fixture(scope="module")
def marked(spark, tmp_path_factory):
    """A folder with documents and conversations of such texts, and DuckDB over it."""
    folder = str(tmp_path_factory.mktemp("marked"))
    long = " ".join(MARKED * 3) + " word" * 70 + " J. xi. Tail of it."  # chunks change where a sentence does
    texts = [*MARKED, "\n".join(MARKED), long]
    con = duckdb.connect()
    for name, rows, shape in (
        ("documents", [(8 * i, text, "en", "ab"[i % 2], len(text)) for i, text in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"),
        ("conversations", [(i, k, "user", text) for i in range(1, 3) for k, text in enumerate(texts)], "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["t12_sentences", "t13_fitted_sentences", "t14_packed_chunks", "t15_document_chunks", "t18_chunk_fingerprints", "a01_characters", "a14_fragmentation", "flagship_chunked_documents", "j08_read_along"])
def test_list_markers_after_false_breaks(spark, marked, name):
    """Each marker holds the sentence open in these queries, as in their SQL, wherever a sentence begins."""
    folder, con = marked
    found = QUERIES[name](spark, folder)
    wanted = con.execute(SQL[name])
    names = sorted(c[0] for c in wanted.description)
    rows = wanted.fetchall()
    place = [[c[0] for c in wanted.description].index(n) for n in names]
    assert sorted(tuple(canonical(r[n]) for n in names) for r in found.collect()) == sorted(tuple(canonical(r[i]) for i in place) for r in rows)
