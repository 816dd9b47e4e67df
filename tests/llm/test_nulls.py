"""NULL and repeated ids, NULL items, clashing column names."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quorumcast.llm import block_anchors, positional_index, sharding

from . import brute
from .conftest import prose, plain


def test_null_ids_are_larger_than_any_in_op2(spark):
    import random

    rng = random.Random(1)
    passage = prose(rng, 30)
    rows = [(5, passage + " tail"), (None, "head " + passage), (3, passage), (None, passage + " end"), (2 ** 60 + 1, "own " + prose(rng, 20)), (None, None)]
    got = plain(block_anchors.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_words", "n_removed", "kept_sha256")
    big = 2 ** 63 - 1
    want = brute.without_word_windows([(big if i is None else i, t) for i, t in rows])
    assert got == sorted(w[1:] for w in want)
    ids = [r[0] for r in block_anchors.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert Counter(ids) == Counter(r[0] for r in rows)


def test_null_ids_and_null_items_in_op6(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    other = " ".join(f"v{i}" for i in range(20))
    rows = [(None, phrase), (None, "nothing here"), (2 ** 60 + 1, f"x {other} y"), (4, phrase), (4, "clean text"), (None, phrase)]
    items = [(None, phrase), ("b", other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in positional_index.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, 13, 13, []), (None, 13, 13, []), (None, 2, 0, []), (2 ** 60 + 1, 22, 20, ["b"]), (4, 13, 13, []), (4, 2, 0, [])], key=str)


def test_contaminated_rows_go_and_clean_ones_of_the_same_id_stay(spark, tmp_path):
    phrase = " ".join(f"w{i}" for i in range(13))
    spark.createDataFrame([("a", phrase)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(5, phrase, 1), (5, "clean", 2), (None, phrase, 3), (None, "clean too", 4), (6, None, 5)], "doc_id bigint, text string, k int")
    assert sorted(r.k for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [2, 4, 5]


def test_language_stage_keeps_columns_of_other_names(spark):
    docs = spark.createDataFrame([(i, "the words of a text", "en", f"x{i}", i) for i in range(5)], "doc_id bigint, text string, lang string, lang_pred string, score int")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_wide_rows_are_placed_whole(spark, docs):
    df = docs.unionByName(docs.limit(20)).withColumn("tags", F.array(F.lit(1), F.col("k"))).withColumn("shard", F.lit("taken"))
    out = sharding.shuffle_rows_into_shards(df, 5)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    rows = out.collect()
    assert Counter(str(r[:-2]) for r in map(tuple, rows)) == Counter(str(tuple(r)) for r in df.drop("shard").collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
