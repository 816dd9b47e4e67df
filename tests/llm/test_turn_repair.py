"""Conversation repair against trying every edit."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quorumcast.llm import queries, turn_repair

from .brute import repaired, sha

SCHEMA = "conv_id bigint, turn int, role string, text string, kinds int, digest string, place string"
EMPTY = (0, 0, 0, 0, 0, 0, "", sha(b""))


def want(rows):
    """Rows of one turn by role, then by the hash that the docstring names (MD5 of role and text)."""
    import hashlib

    clean = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    clean.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    return {c: (*v[:7], sha(v[7].encode())) for c, v in repaired(clean).items()}


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    done, counts = turn_repair.repair(df, **options)
    one = turn_repair.digests(done).withColumnRenamed("conv_id", "c")
    wide = counts.join(one, F.col("conv_id").eqNullSafe(F.col("c")))
    return {r[0]: tuple(r[1:]) for r in wide.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def talk(rng, conv, n):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "\n\t", "a. ", "tail.\x0b\n"] + [f"t{i}." for i in range(20)]
    turns = sorted((rng.choice([None, *range(n)]) if rng.random() < 0.1 else i for i in range(n)), key=lambda t: (t is not None, t or 0))
    return [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repairs_match_trying_every_edit(spark, block):
    rng = random.Random(block)
    rows = [r for c in range(60) for r in talk(rng, c if c else None, rng.choice([1, 2, 3, 5, 8, 30]))]
    rows += [r for r in rows if rng.random() < 0.1]
    rows += [(99, i, "user" if i % 3 else "assistant", "the same." if i % 2 else f"{i}?") for i in range(200)]
    rows += [(100, 7, "user", "again.")] * 50
    found, wanted = got(spark, rows, block=block), want(rows)
    assert set(found) == set(wanted)
    for c in wanted:
        assert found[c] == wanted[c], c


def test_small_cases(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "assistant", "Ho."), (3, 0, "user", ""), (4, None, None, None),
            (5, 0, "system", "S."), (5, 1, "user", "x" * 300_000)]
    found = got(spark, rows)
    assert found[1] == (0, 0, 0, 0, 0, 0, "KK", sha(b"user:Hi.\nassistant:Ho."))
    assert found[2][5:] == (2, "IK", sha(b"user:\nassistant:Ho."))
    assert found[3] == (0, 1, 0, 0, 0, 3, "D", sha(b""))
    assert found[4] == (0, 1, 0, 0, 0, 3, "D", sha(b""))
    assert found[5] == (0, 0, 0, 1, 0, 3, "KKI", sha(b"system:S.\nuser:" + b"x" * 300_000 + b"\nassistant:"))


def test_blocks_are_cut_and_matrices_agree(spark):
    rng = random.Random(4)
    kinds = bytes(rng.choice(list(turn_repair.KINDS)) for _ in range(500))
    whole, _ = turn_repair.cross_blocks([turn_repair._matrix(turn_repair.condense(kinds))])
    cut = [kinds[i:i + 7] for i in range(0, 500, 7)]
    states, _ = turn_repair.cross_blocks([turn_repair._matrix(turn_repair.condense(b)) for b in cut])
    assert states[-1] == whole[-1]
    parts = [i for b, p, q in zip(cut, [0, *states], states) for i in turn_repair.initials(b, p, q)]
    assert parts == turn_repair.initials(kinds, 0, whole[-1])


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_query_on_the_test_table(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows, every = [], set()
    for c, t, r, x in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        every.add(c)
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fault == 0:
            continue
        x = "" if fault == 1 else "".join(ch for ch in x if ch not in ".!?") if fault == 2 else x
        rows += [(c, t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    wanted = dict.fromkeys(every, EMPTY) | want(rows)
    assert {r[0]: tuple(r[1:]) for r in queries.op11_turn_repair(spark, folder).collect()} == wanted
