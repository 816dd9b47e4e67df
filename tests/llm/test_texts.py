"""Audio, language model, contamination, boilerplate, language and SimHash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumcast.llm import audio, boilerplate, langid, positional_index, ppm, simhash_links
from quorumcast.llm.queries import held_out

from .brute import WORD, components, contamination, lower
from .conftest import plain, prose


def test_media_round_trip(docs, rows):
    got = {r.id: r for r in audio.features(audio.media_column(docs)).collect()}
    assert len(got) == len(rows)
    features = {}
    for i, t, *_ in rows:
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(audio.encode(payload)).hexdigest() and r.media_bytes == 44 + len(payload)
        assert features.setdefault(t or "", r.feature) == r.feature
        table = pa.ipc.open_stream(r.tensors).read_all()
        assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), [64, 32])
        assert sum(table["n_frames"].to_pylist()) == int(re.match(r"frames=(\d+)", r.feature)[1])
        assert all(a < z for a, z in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
    assert len(set(features.values())) > 0.8 * len(features)


def test_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(8000) / audio.RATE
    for hz, kept in ((500, True), (7000, False)):
        y = audio.resample(np.sin(2 * np.pi * hz * t), 0, 4000, audio._BANK)[100:-100]
        assert (np.abs(y).max() > 0.9) == kept and (kept or np.abs(y).max() < 0.05)


def test_resampling_and_features_do_not_depend_on_blocks(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8)
    whole = np.concatenate(list(audio.log_mel(samples, audio.RATE)))
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 17)
    assert np.allclose(whole, np.concatenate(list(audio.log_mel(samples, audio.RATE))))


def test_hysteresis():
    e = np.array([0, 0, 10, 5, 5, 10, 3, 0, 5, 5, 5, 0, 10, 0.0])
    assert audio.segments(e) == [(2, 6)]
    assert audio.segments(np.ones(5)) == []


def model(rows, order=ppm.ORDER):
    """log10 probability of each text by a plain trie with exclusion."""
    def sequence(t):
        return b"\0" * order + b"".join(w.encode() + b" " for w in WORD.findall(lower(t or ""))) + b"\n"

    counts = {}
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = sequence(t)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    counts.setdefault(s[p - k:p], Counter())[s[p]] += 1

    def byte(s, p):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            here = {b: n for b, n in counts.get(s[p - k:p], {}).items() if b not in gone}
            total = sum(here.values())
            if s[p] in here:
                return out + math.log10((here[s[p]] - 0.5) / total)
            if here:
                out += math.log10(0.5 * len(here) / total)
            gone |= set(here)
        return out - math.log10(256 - len(gone))

    return {i: sum(byte(s, p) for p in range(order, len(s))) for i, s in ((i, sequence(t)) for i, t, *_ in rows)}


@pytest.mark.parametrize("unit_bytes", [1 << 22, 3000])
def test_language_model_scores(docs, rows, unit_bytes):
    got = {r.doc_id: r for r in ppm.score(docs, ~held_out(2, 7), unit_bytes=unit_bytes).collect()}
    tokens = {i: WORD.findall(lower(t or "")) + [None] for i, t, *_ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    want = model(rows)
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, want[i], rel_tol=1e-5, abs_tol=1e-4)


def test_language_model_is_a_distribution():
    keys = np.array([0x6162636465, 0x6162636466, 0x7A62636465], np.uint64) << np.uint64(8) | np.uint64(97)
    pairs = np.zeros((256, 256), np.int64)
    pairs[0x65, 97], pairs[0x66, 97] = 2, 1
    asked = (np.uint64(0x6162636465) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
    logs = ppm.log_probabilities(asked, np.sort(keys), np.array([1, 1, 1]), pairs)
    assert math.isclose((10 ** logs).sum(), 1.0, rel_tol=1e-9)


def test_language_model_without_training_or_rows(docs, no_docs):
    got = ppm.score(docs.filter("doc_id < 9"), F.lit(False)).collect()
    for r in got:
        assert r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.base_score, 0.0, abs_tol=1e-9) and r.held_out
        assert math.isclose(r.score / math.log10(1 / 256), round(r.score / math.log10(1 / 256)), abs_tol=1e-4)
    assert ppm.score(no_docs, ~held_out(2, 7)).count() == 0


def benchmark_rows(rows):
    rng = random.Random(2)
    words = [r[1].split(" ") for r in rows if r[1] and len(r[1].split(" ")) > 60]
    items = [(i, " ".join(w[10:10 + n]).upper()) for i, (w, n) in enumerate(zip(words, (13, 14, 40, 12, 5, 2)))]
    return items + [(90, None), (91, "..!"), (92, prose(rng, 20)), (None, "the an"), (93, "the the"), (93, "the the")]


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_contamination(spark, docs, rows, block_words):
    items = benchmark_rows(rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = positional_index.contamination(docs, bench, block_words=block_words)
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect())
    # An item without an id hits like any other, but is not named.
    want = contamination([(r[0], r[1]) for r in rows], items)
    assert got == [(*w[:3], [x for x in w[3] if x != "None"]) for w in want]
    assert any(r[2] for r in got)


def test_contamination_of_repeated_rows_and_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, "the the the")], "item_id bigint, text string")
    twice = docs.filter("doc_id in (8, 9)").unionByName(docs.filter("doc_id = 8"))
    assert sorted((r.doc_id, r.n_hit) for r in positional_index.contamination(twice, bench).collect()) == [(8, 3), (8, 3), (9, 3)]
    assert positional_index.contamination(no_docs, bench).count() == 0
    assert positional_index.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x blue"), (3, "blue. RED"), (4, "red"), (5, None)], "doc_id bigint, text string")
    tests = positional_index.TestWindows([("t", positional_index.hashed_terms("red blue"))])
    index = positional_index.build_index(docs, tests.vocabulary)
    assert plain(positional_index.proximity(index, tests, "red", "blue", 3), "id", "n_near") == [(1, 1), (3, 1)]


def test_boilerplate(spark):
    nav = "Home\nAbout us"
    pages = [(i, "a.com", f"{nav}\nstory {i}\n\n story {i} ", "x") for i in range(10)] + [(10, "a.com", "story 1\nHome", "x"), (11, "b.com", nav, None),
             (12, None, nav, "x"), (13, None, None, "x"), (14, "b.com", "", "x"), (11, "b.com", nav, None)]
    df = spark.createDataFrame(pages, "page_id bigint, host string, text string, n_lines string")
    got = sorted(((r.page_id, r.text, r.n_lines, r.n_dropped) for r in boilerplate.drop_boilerplate(df, "host", "text").collect()), key=str)
    want = [(i, f"story {i}\nstory {i}", 4, 2) for i in range(10)] + [(10, "story 1", 2, 1), (11, "", 2, 2), (11, "", 2, 2), (12, nav, 2, 0),
            (13, "", 0, 0), (14, "", 0, 0)]
    assert got == sorted(want, key=str)
    assert boilerplate.drop_boilerplate(df.limit(0), "host", "text").count() == 0


def test_page_text_and_host(spark):
    html = "<html><head><title>t</title><script>a<b>\n</script></head><body><p>One <b>two</b></p><!-- x\n --><div>three<br>four</div></body></html>"
    r = spark.createDataFrame([("HTTP://u@Some.Host:80/x?y", html), (None, None), ("no url", "")], "url string, html string").select(
        boilerplate.host(F.col("url")).alias("h"), boilerplate.lines(boilerplate.page_text(F.col("html"))).alias("l")).collect()
    assert [tuple(x) for x in r] == [("some.host", ["One two", "three", "four"]), (None, []), (None, [])]


def languages(spark):
    rng = random.Random(9)
    words = {"en": "the and of tion ing with that".split(), "de": "der und die schaft ung mit ein".split(), "fr": "le et des ment eau avec une".split()}
    rows = [(i, " ".join("".join(rng.choices(words[name], k=rng.randint(1, 2))) for _ in range(rng.randint(4, 80))), name)
            for i in range(240) for name in [("en", "de", "fr")[i % 3]]]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_profiles(spark):
    rows, df = languages(spark)
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "de"), (902, "123 %%", None), (903, "The And Of", None)], df.schema)
    profiles = langid.learn(df.unionByName(odd).filter(~held_out(2, 4)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.unionByName(odd), profiles).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(got[r[0]][0] == r[2] for r in held) >= 0.98 * len(held)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and got[903][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_of_odd_tables(docs, no_docs):
    nothing = langid.learn(no_docs)
    assert set(r.lang_pred for r in langid.predict(docs, nothing).collect()) == {"und"}
    assert langid.predict(no_docs, nothing).count() == 0
    out = langid.predict(docs, nothing, label="k", score="unit")
    assert sorted(out.columns) == sorted(docs.columns)


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("abÄ .𝒳", k=rng.randint(0, 60)))
        whole = langid.ngram_counts(text)
        plain_text = "\1" + re.sub("\1+", "\1", "".join(c if c.isalpha() else "\1" for c in text.lower()) + "\1").lstrip("\1")
        want = Counter()
        for i in range(len(plain_text)):
            for n in (1, 2, 3):
                if i + n <= len(plain_text) and not (n == 1 and plain_text[i] == "\1"):
                    code = 0
                    for c in plain_text[i:i + n]:
                        code = code << 21 | ord(c)
                    want[code] += 1
        assert dict(zip(*(x.tolist() for x in whole))) == (want if text else {})
        with monkeypatch.context() as m:
            m.setattr(langid, "_PIECE", 3)
            pieces = langid.ngram_counts(text)
        assert dict(zip(*(x.tolist() for x in pieces))) == dict(zip(*(x.tolist() for x in whole)))


def plain_fingerprint(text):
    words = lower(text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)) if shingles else 0


def test_fingerprints_and_components(docs, rows, monkeypatch):
    got = {r.doc_id: r for r in simhash_links.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    assert [got[r[0]].fp & (2**64 - 1) for r in rows] == fps
    assert [got[r[0]].component_id for r in rows] == components(fps)
    text = prose(random.Random(1), 500)
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash_links, "_PIECE", 70)
    assert simhash_links.fingerprint(text) == want
    assert simhash_links.fingerprint("a " * 2) == plain_fingerprint("a a")


@pytest.mark.parametrize("direct", [2048, 4])
def test_links_of_crowded_fingerprints(spark, monkeypatch, direct):
    rng = random.Random(direct)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << rng.choice((0, 1, 2, 31, 32, 33, 50, 62, 63)) for _ in range(rng.randint(0, 3))) & (2**64 - 1)
                  for b in base for _ in range(60)})
    forest = simhash_links.Forest()
    monkeypatch.setattr(simhash_links, "DIRECT", direct)
    keys = {}
    for f in fps:
        for v in range(64):
            half, bit = divmod(v, 32)
            keys.setdefault((v, (f >> 32 * half & 0xFFFFFFFF) & ~(1 << bit)), []).append(f)
    flat = [(n, f) for n, k in enumerate(keys) for f in keys[k]]
    simhash_links.link_buckets(np.array([n for n, _ in flat]), np.array([f for _, f in flat], np.uint64), forest)
    got = [forest.root(f) for f in fps]
    assert got == [fps[i] for i in components(fps)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.node: r.root for r in simhash_links.components(simhash_links.edges(df), "test").collect()}
    groups = {}
    for f, g in zip(signed, components(fps)):
        groups.setdefault(g, []).append(f)
    assert all({found.get(f, f) for f in g} == {min(g)} for g in groups.values())


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert plain(simhash_links.components(links, "chain"), "node", "root") == [(i, 0) for i in range(61)] + [(100, 100), (101, 100)]


def test_simhash_of_an_empty_table(no_docs):
    assert simhash_links.near_duplicates(no_docs).count() == 0
