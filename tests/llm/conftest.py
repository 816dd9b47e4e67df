import random

import pytest

SYLLABLES = "the an ou er ing ö ñas tion re ha st é".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, unit string, k int"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus():
    """Documents with copies, near copies, shared passages, NULLs and odd texts."""
    rng = random.Random(5)
    passage, line = prose(rng, 80), prose(rng, 12)
    texts = [None, "", " ", "\n\t ", "a", "Ünïcode", "x" * 700, "ab " * 400, "the the the", "THE the\x0bthe"]
    texts += [prose(rng, rng.choice([3, 14, 60, 200])) for _ in range(30)]
    texts += [texts[12]] * 3 + [texts[20]] * 2
    texts += [prose(rng, 20) + " " + passage + "\n" + prose(rng, 15) for _ in range(6)]
    texts += [line + "\n" + prose(rng, 40) + "\n" + line for _ in range(5)]
    near = prose(rng, 300).split(" ")
    for i in range(6):
        w = list(near)
        w[i * 40] = "changed"
        texts.append(" ".join(w))
    texts.append(prose(rng, 9000))
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], None if i % 11 == 0 else f"s{min(i % 5, 2)}", None if t is None else len(t), "x", None, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
