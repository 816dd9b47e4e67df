"""Spelling variants against comparing all pairs."""

import os
import random
import re
import zlib
from collections import Counter

import pytest

from quorumcast.llm import queries, spelling

from .brute import lower


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def grouped(counts, factor=10):
    by_pattern = {}  # words that agree with one letter left out or replaced
    for w in counts:
        for i in range(len(w)):
            by_pattern.setdefault((w[:i], w[i + 1:]), set()).add(w)
    neighbours = {w: set() for w in counts}
    for (a, b), ws in by_pattern.items():
        for w in ws | ({a + b} & set(counts)):
            neighbours[w] |= {x for x in ws | ({a + b} & set(counts)) if near(w, x)}
    form = {}
    for w, ns in neighbours.items():
        if ns:
            best = min(ns, key=lambda x: (-counts[x], x))
            if counts[best] >= factor * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(neighbours[w]), counts[form[w]] if w in form else None) for w in counts)


def words_of(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def test_variants_match_comparing_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(7, 10))) for _ in range(400)}
    long = "".join(rng.choices("abcd", k=3000))
    words |= {long, long[:5] + long[6:], long[:2000] + "z" + long[2000:], long[:-1], long[:1500] + "q" + long[1501:], "x" + long}
    words |= {"a" * n for n in range(7, 40)} | {"漢" * 8, "漢" * 7 + "字", "😀" * 9, "b"}
    counts = {w: rng.choice([2, 3, 5, 20, 30, 400, 5000]) for w in sorted(words)}
    df = spark.createDataFrame([*((w, n, 0) for w, n in counts.items()), (None, 9, 1)], "word string, n bigint, node int")
    got = sorted(map(tuple, spelling.group_variants(df).collect()))
    assert got == grouped(counts)
    assert any(r[1] is not None and r[1] != r[2] for r in got)


def test_many_words_of_one_pattern_leave_only_true_pairs(spark):
    words = [f"pattern{a}{b}suffix" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]
    counts = dict.fromkeys(words, 2) | {"patternausuffix": 20}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert sorted(map(tuple, spelling.group_variants(df).collect())) == grouped(counts)


def test_words_of_documents(spark):
    rows = [(1, "Ünïcode ÀÉÎÕÜ×÷ abcdefg ABCDEFG a-b"), (2, "abcdefg abcdefgh1abcdefg"), (None, "abcdefg " * 40), (3, None), (4, ""), (5, "x" * 50_000), (6, "X" * 50_000)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id bigint, text string, word string")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == words_of(rows)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_on_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_spelling(spark, folder).collect())) == grouped(words_of(map(tuple, rows)))


def test_staged_words_are_not_planned_as_broadcasts(spark, tmp_path):
    """A file of words unpacks to many times its size, which only a measurement shows."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (planned, measured)}
    spark.createDataFrame([("reading", 30), ("readimg", 2), ("readings", 3)], "word string, n bigint").write.parquet(f"{tmp_path}/words")
    try:
        spark.conf.set(planned, "10485760b")
        spark.conf.unset(measured)
        found = spelling.group_variants(spark.read.parquet(f"{tmp_path}/words"))
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        assert spark.conf.get(measured) == "10485760b"
        assert sorted(tuple(r) for r in found.collect()) == [
            ("readimg", "reading", "reading", 2, 1, 30), ("reading", None, "reading", 30, 2, None), ("readings", "reading", "reading", 3, 1, 30)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
