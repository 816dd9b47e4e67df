"""Queries and pipeline on the test tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quorumcast.llm import oracles, queries

from .brute import contamination
from .test_near_copies import kept_of_groups

FOLDER = "/root/testdata/sf0.001"


def test_each_operator_has_a_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    want = con.execute(oracles.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_pipeline_stages(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), FOLDER)
        if name != "sharding":
            assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        texts = {r[0]: r[1] for r in rows}
        if name == "language_id":
            assert sorted(kept) == sorted(r for r in rows if any(c.isalpha() for c in r[1] or ""))
        elif name == "simhash":
            assert sorted((r[0], r[1]) for r in kept) == kept_of_groups([(r[0], r[1]) for r in rows])
        elif name == "decontamination":
            bad = {i for i, n, hit, _ in contamination(list(texts.items()), bench) if hit and 20 * hit >= n}
            assert bad and sorted(r[0] for r in kept) == sorted(set(texts) - bad)
        elif name == "mixing":
            assert set(kept) <= set(rows) and max(Counter(kept).values()) <= 3
        else:
            assert Counter(r[:5] for r in kept) == Counter(rows)
            sizes = Counter(r[5] for r in kept)
            assert max(sizes.values()) - min(sizes.values()) <= 1
        rows = kept
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(kept)


def test_results_do_not_depend_on_partitions(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    for name in ("op1_sharding", "op9_mixing", "op10_simhash", "op8_language_id"):
        seen = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, queries.queries()[name](spark, FOLDER).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1], name
