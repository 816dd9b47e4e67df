"""Sharding and mixing."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quorumcast.llm import mixing, sharding

from .brute import WORD


def test_matrix_has_exact_margins_and_the_right_mean():
    sizes = [5, 0, 113, 40, 7]
    total = sum(sizes)
    seen = []
    for seed in range(600):
        m = sharding.communication_matrix(sizes, 4, seed)
        assert [sum(r) for r in m] == sizes
        columns = [sum(c) for c in zip(*m)]
        assert sum(columns) == total and max(columns) - min(columns) <= 1
        seen.append(m[3][1])
    want = 40 * 41 / total
    assert abs(sum(seen) / len(seen) - want) < 0.5
    variance = sum((x - want) ** 2 for x in seen) / len(seen)
    p = 41 / total
    assert abs(variance - 40 * p * (1 - p) * (total - 40) / (total - 1)) < 1.2


def test_hypergeometric_edges():
    rng = random.Random(1)
    assert sharding.hypergeometric(rng, 0, 5, 10) == 0
    assert sharding.hypergeometric(rng, 10, 5, 10) == 5
    assert sharding.hypergeometric(rng, 3, 0, 10) == 0
    assert all(0 <= sharding.hypergeometric(rng, 7, 6, 10) - 3 <= 3 for _ in range(200))


@pytest.mark.parametrize("copies", [1, 3])
def test_shards_have_exact_sizes_and_gapless_slots(docs, copies):
    df = docs
    for _ in range(copies - 1):
        df = df.unionByName(docs)
    out = sharding.shuffle_into_shards(df.withColumn("_s_part", F.lit(1)), 7, ["doc_id", "text"])
    assert out.columns == [*docs.columns, "_s_part", "shard", "slot"]
    rows = out.select("doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in rows) == {i: copies for i in range(docs.count())}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(7))
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_shuffle_is_repeatable_and_moves_rows(docs):
    one, two = (sorted(map(tuple, sharding.shuffle_into_shards(docs.repartition(n), 4, ["doc_id"]).select("doc_id", "shard", "slot").collect()))
                for n in (2, 5))
    assert one == two
    other = sorted(map(tuple, sharding.shuffle_into_shards(docs, 4, ["doc_id"], seed=3).select("doc_id", "shard", "slot").collect()))
    assert one != other


def test_shuffle_of_an_empty_table_and_of_null_keys(docs, no_docs):
    assert sharding.shuffle_into_shards(no_docs, 16, ["doc_id"]).count() == 0
    out = sharding.shuffle_into_shards(docs.withColumn("shard", F.lit("old")), 3, ["n_chars"]).select("shard").collect()
    assert sorted(Counter(r.shard for r in out).values()) == sorted([len(out) // 3 + (s < len(out) % 3) for s in range(3)])


def water_fill(sizes, weights, most):
    """Exact targets: take out the sources over their cap until none is."""
    left, free, out = Fraction(sum(sizes.values())), dict(weights), {}
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in free.items()}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            del free[s]
    return out


def test_mix_reaches_targets(docs, rows):
    sized = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("copies", F.lit("old"))
    out = mixing.copies(sized).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    words = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert all(r["size"] == words[r.doc_id] for r in out)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words[r[0]]
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        rate = r.target / r.source_size
        assert 0 <= r.copies <= 3 and abs(r.copies - rate) < 1
    for s in names:  # copies are systematic: their number is exact up to one
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.copies for r in mine) - len(mine) * float(want[s]) / sizes[s]) <= 1


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 1000, "b": 10, "c": 20, "d": 400}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
    want = water_fill(sizes, {"a": 1, "b": 2, "c": 3, "d": 1}, 3)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(float(t), 6) for s, t in want.items()}
    assert abs(sum(r.target for r in got) - 1430) < 1e-6


def test_mixed_rows_and_odd_tables(spark, docs, no_docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = mixing.copies(docs.withColumn("size", mixing.word_count(F.col("text")))).agg(F.sum("copies")).first()[0]
    assert mixed.count() == taken
    assert mixing.mix(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in mixing.copies(nothing.withColumn("size", F.lit(0).cast("bigint"))).select("target", "copies").collect()] == [(0.0, 0)] * 2


def test_native_plans_hold_no_python(docs):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    for df in (mixing.copies(sized), sharding.shuffle_into_shards(sized, 4, ["doc_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
