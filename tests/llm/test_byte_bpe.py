"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumcast.llm import byte_bpe, queries

tiktoken = pytest.importorskip("tiktoken")
vocabulary = pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")
PATH = vocabulary.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(rng, n):
    return "".join(rng.choices(" ''' stmdrevl  \n\n\t　\x85é1²٣漢字-—😀\x1c\x00", k=n))


def test_pieces_are_the_matches_of_the_pattern():
    space = "".join(map(chr, byte_bpe.WHITE_SPACE))
    pattern = vocabulary.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"\s", f"[{space}]")
    rng = random.Random(1)
    for _ in range(2000):
        rows = [odd(rng, rng.randint(0, 14)) for _ in range(rng.randint(1, 6))]
        raw = [r.encode() for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        want = [int(o) + len(r[:m.start()].encode()) for o, r in zip(offsets, rows) for m in regex.finditer(pattern, r)]
        assert byte_bpe.piece_starts(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist() == want


@pytest.mark.parametrize("unit_bytes", [byte_bpe.UNIT_BYTES, 3000])
def test_both_ways_match_the_library(spark, rows, ranks, library, unit_bytes, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ENTRIES", 50)
    rng = random.Random(2)
    texts = [r[1] for r in rows] + [odd(rng, 200) for _ in range(30)] + ["<|endoftext|>", "a" * 3000, " " * 2000 + "x", "-=" * 700, "it's we'll DON'T 'tis"]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, ids string, unit int").repartition(3)
    one = byte_bpe.encode(df, ranks, unit_bytes=unit_bytes, check=True).withColumnRenamed("decoded", "same")
    both = byte_bpe.decode(one, ranks)
    assert both.filter("same <> decoded").count() == 0
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded), r.numbers) for r in both.withColumn("numbers", byte_bpe.as_array(F.col("ids"))).collect()]
    numbers = [library.encode_ordinary(t or "") for t in texts]
    want = [(i, np.array(n, "<u4").tobytes(), (t or "").encode(), n) for i, t, n in zip(ids, texts, numbers)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_merges_of_a_small_vocabulary_take_the_lowest_rank_first(spark):
    small = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate([b"bc", b"ab", b"abc", b"aa", b"aaa", b"aaaa", b"cb", b"abcb"])}
    own = tiktoken.Encoding("small", pat_str=vocabulary.PATTERN, mergeable_ranks=small, special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    got = df.select(byte_bpe.merged(F.col("word"), byte_bpe.rank_map(small)).alias("t")).collect()
    assert [r.t for r in got] == [own.encode_ordinary(w) for w in words]


def test_units_are_shuffled_once(spark, docs, ranks):
    df = byte_bpe.encode(docs, ranks)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark, no_docs, ranks):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, ranks), ranks).collect() == []


def test_rank_file(ranks):
    with open(PATH, "rb") as f:
        token, rank = f.readline().split()
    assert ranks[base64.b64decode(token)] == int(rank)


def test_query_on_the_test_table(spark, library):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    want = []
    for i, t in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        n = library.encode_ordinary(t or "")
        want.append((i, len(n), hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, folder).collect())) == sorted(want)
