"""The registered queries: SQL checks on the small tables, and the pipeline from end to end."""

import duckdb
import pytest

import corpus_pipeline
from hopledger.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    expected = con.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in found.select(*names).collect()) == key(expected.fetchall())


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) and all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}


def test_stages_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == list(corpus_pipeline.COLUMNS)
        assert rows.count() >= 0
    first = corpus_pipeline.identify_language(spark, odd, SF)
    assert {r.doc_id for r in first.collect()} == {4, 5, None, 8, 9, 10, 11}
    second = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in second.collect()) == sorted(str(i) for i in (1, 2, 3, 4, None, 7, 8, 9, 10, 11))


def test_near_copies_at_80_percent_go_and_texts_under_one_id_stay(spark, documents):
    words = [f"w{k}" for k in range(105)]
    near = [w if k not in (20, 70) else f"other{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "one text of its own"), (3, "and something quite different"), (3, "one text of its own")]
    found = corpus_pipeline.drop_near_duplicates(spark, documents(rows), SF).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted({rows[0], rows[2], rows[3]})
