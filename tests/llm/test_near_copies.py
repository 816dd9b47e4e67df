"""The pipeline's near-copy stage against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quorumcast.llm import near_copies
from quorumcast.llm.simhash_links import Forest

from .conftest import prose


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_of_groups(rows):
    """(id, text) of the smallest id of each group; ids may repeat or be NULL."""
    sets = [five(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        best.setdefault(root(i), []).append(row)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in best.values()), key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("block", [near_copies.BLOCK, 1024])
def test_near_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(block)
    common, texts = prose(rng, 30), [None, "", " \n", "a b", "A  b", "c d"]
    for n in (40, 60, 120, 250):
        base = prose(rng, n).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 6):
            w = list(base)
            for at in rng.sample(range(n), changes):
                w[at] = f"new{rng.random()}"
            texts.append(" ".join(w))
    texts += [common + " " + prose(rng, rng.choice([4, 8, 40])) for _ in range(30)]
    rows = list(enumerate(texts))
    rows += [(7, texts[7]), (7, "another text under an id in use"), (None, texts[9]), (None, "no id and no copy"), (None, "no id and no copy")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=str)
    assert [r[0] for r in got] == sorted([r[0] for r in kept_of_groups(rows)], key=str)


def test_near_copies_of_an_empty_table(no_docs, spark):
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").count() == 0


def test_a_group_leaves_a_forest_and_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16 * near_copies.LEAST)
    rng = random.Random(9)
    base, texts = prose(rng, 200).split(), []
    for _ in range(120):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = f"new{rng.random()}"
        texts.append(" ".join(w))
    # Any two differ by more than the limit; only the base, which comes last, connects them.
    texts.append(" ".join(base))
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    links = near_copies.links(rows, near_copies.prefixes(rows, 5), 5)
    assert links.count() <= 4 * len(texts)
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_clashing_columns_keep_their_values(spark):
    rows = [(1, "a b c", 7, 8), (2, "A b  c", 9, 10), (None, "other", 11, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row int, _place int")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_sets_at_the_limit_share_a_signature_and_are_close():
    rng, drawn, seen = np.random.default_rng(3), near_copies._drawn(), []
    for n in (20, 60, 300):
        for _ in range(100):
            common = -(-17 * n // 18)  # a Jaccard similarity of about 0.9
            h = rng.integers(0, 1 << 48, 2 * n - common)
            a, b = (near_copies.simhash(x) for x in (h[:n], np.concatenate([h[:common], h[n:]])))
            apart = np.unpackbits(a ^ b)
            seen.append((apart[drawn].sum(axis=1) == 0).any() and apart[:128].sum() <= near_copies.MOST)
    assert np.mean(seen) >= 0.99
    one, other = (near_copies.simhash(rng.integers(0, 1 << 48, 100)) for _ in range(2))
    assert np.unpackbits(one ^ other)[:128].sum() > near_copies.MOST


@pytest.mark.parametrize("small, direct", [(64, 1024), (2, 1024), (2, 4)])
def test_a_bucket_connects_what_is_close_however_large(monkeypatch, small, direct):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "DIRECT", direct)
    fps = np.full((9, 2), 1 << 63, np.uint64)
    fps[3:6, 0] = (1 << 64) - 1  # 63 bits from the others
    forest = Forest()
    near_copies._meet(np.repeat([1, 2], [8, 1]), np.arange(9), fps, forest)
    roots = [forest.root(i) for i in range(9)]
    assert roots == ([0] * 8 if direct < 8 else [0, 0, 0, 3, 3, 3, 0, 0]) + [8]


def test_texts_meet_by_fingerprints_and_have_one_home(spark):
    """Near copies meet, and the rest of the corpus brings no set of hashes, however much of a passage it shares."""
    rng = random.Random(11)
    passage, base = prose(rng, 60), prose(rng, 200).split()
    texts = [" ".join(base), " ".join(base[:-2]), " ".join([*base[:50], "changed", *base[51:]])]
    texts += [passage + " " + prose(rng, 120) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    found = near_copies.homes(near_copies.prefixes(rows, 5)).collect()
    assert {r.node for r in found} == {near_copies._node(near_copies._words(t)) for t in texts[:3]}
    assert len(found) == 3 and len({r.home for r in found}) == 1


def at_the_limit(rng, n):
    """Two texts whose sets of shingles have a similarity of 0.8 or little more."""
    w = prose(rng, n).split()
    base, other = [f"{x}{i}" for i, x in enumerate(w)], [f"{x}{i}" for i, x in enumerate(w)]
    tail = 1
    while 5 * (n - 4 - tail - 1) >= 4 * (n - 4 + tail + 1):
        tail += 1
    other[-tail:] = [f"other{rng.random()}" for _ in range(tail)]
    return " ".join(base), " ".join(other)


def test_no_pair_is_missed_where_no_signature_is_shared(spark, monkeypatch):
    """SimHash finds a pair at the limit in most cases, shingles in all: even if no fingerprints are close."""
    monkeypatch.setattr(near_copies, "MOST", -1)
    rng, texts = random.Random(21), []
    for n in (6, 9, 14, 30, 130, 250, 900):
        for _ in range(4):
            texts += at_the_limit(rng, n)
    texts += [prose(rng, 40) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = [r[0] for r in kept_of_groups(rows)]
    assert len(want) == len(rows) - 20  # pairs of 2 and 5 shingles cannot be so close without being equal
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()] == want


def test_sketches_never_rule_out_a_linked_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 100, 128, 130, 1000):
        for share in (1.0, 0.95, 8 / 9):
            common = -(-int(n * share * 9) // 9)
            h = rng.integers(0, 1 << 48, 3 * n)
            for m in {n, max(common, 4 * n // 5), 5 * n // 4}:
                a, b = h[:n], np.concatenate([h[:common], h[n:n + max(0, m - common)]])
                forest = Forest()
                near_copies._link_home([1, 2], np.array([len(a), len(b)]), [near_copies.sketch(a), near_copies.sketch(b)], forest)
                both = len(np.intersect1d(a, b))
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    assert forest.root(2) == 1, (n, m, common)
    a, b = (rng.integers(0, 1 << 48, 200) for _ in range(2))
    forest = Forest()
    near_copies._link_home([1, 2], np.array([200, 200]), [near_copies.sketch(a), near_copies.sketch(b)], forest)
    assert forest.root(2) == 2


def test_a_large_group_leaves_few_links_between_signatures(spark):
    """What met by shingles goes by one number, so the buckets of signatures do not leave a forest each."""
    rng = random.Random(4)
    base, texts = prose(rng, 300).split(), []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(300)] = f"new{rng.random()}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(8)
    known = near_copies.by_shingles(rows, 5)
    held = {}

    def hold(df, name, **options):
        held[name] = near_copies.stage(df, name, **options)
        return held[name]

    found = near_copies.homes(near_copies.prefixes(rows, 5), hold, known)
    assert found.count() == 150 and found.select("home").distinct().count() == 1
    assert held["near-met-edges"].count() <= 2 * (known.count() + 150)
