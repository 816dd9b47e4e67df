"""Substring and suffix-array deduplication against brute force."""

import random

import numpy as np
import pytest

from quorumcast.llm import block_anchors, suffix_dedup
from quorumcast.llm.suffix_array import common_prefixes, suffix_array

from .brute import without_byte_strings, without_word_windows
from .conftest import plain


@pytest.mark.parametrize("unit_bytes", [1 << 22, 900])
def test_word_windows(docs, rows, unit_bytes):
    got = plain(block_anchors.remove_repeats(docs, unit_bytes=unit_bytes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == without_word_windows([(r[0], r[1]) for r in rows])
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == r[1] > 0 for r in got)


@pytest.mark.parametrize("unit_bytes", [1 << 22, 900])
def test_byte_strings(docs, rows, unit_bytes):
    got = plain(suffix_dedup.remove_repeats(docs, unit_bytes=unit_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == without_byte_strings([(r[0], r[1]) for r in rows])
    assert any(0 < r[2] < r[1] for r in got)


def test_repeated_rows_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (5, text), (4, " ".join(text.split(" ")[5:30])), (1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert plain(block_anchors.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == without_word_windows(rows)
    assert plain(suffix_dedup.remove_repeats(df, width=50, seed=16), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") \
        == without_byte_strings(rows, 50)


def test_random_small_alphabets(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab \n", k=rng.randint(0, 120)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert plain(block_anchors.remove_repeats(df, width=4, unit_bytes=500), "doc_id", "n_words", "n_removed", "kept_sha256") \
        == without_word_windows(rows, 4)
    assert plain(suffix_dedup.remove_repeats(df, width=9, seed=4, unit_bytes=500), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") \
        == without_byte_strings(rows, 9)


def test_empty_tables(no_docs):
    assert block_anchors.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint16)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        prefixes = common_prefixes(t, sa)
        for r in range(1, len(t)):
            i, j, n = sa[r], sa[r - 1], 0
            while max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert prefixes[i] == n


def test_groups_larger_than_a_sort_are_cut_between_keys():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 101, 60).astype(np.uint8)
    parts = [np.concatenate([rng.integers(97, 101, rng.integers(0, 20)).astype(np.uint8), shared]) for _ in range(20)]
    text, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    groups = np.zeros(20, np.uint32)
    one = suffix_dedup.repeated_windows(text, lengths, groups, 30, 8)
    two = suffix_dedup.repeated_windows(text, lengths, groups, 30, 8, sort_bytes=10)
    ends = np.cumsum(lengths)
    want = np.zeros(len(text), bool)
    times = {}
    for p in parts:
        for a in range(len(p) - 29):
            times[p[a:a + 30].tobytes()] = times.get(p[a:a + 30].tobytes(), 0) + 1
    for e, p in zip(ends, parts):
        for a in range(len(p) - 29):
            want[e - len(p) + a] = times[p[a:a + 30].tobytes()] > 1
    assert (one == want).all() and (two == want).all()
