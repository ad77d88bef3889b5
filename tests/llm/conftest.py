import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, rank int, chunk long, key string, bucket int, block long, h long, part long"


def make_docs(spark, rows):
    """rows: (doc_id, text, source). The other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, 7, 7, "x", 7, 7, 7, 7) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """Null ids and texts, empty, blank and very long texts, repeated rows, copies, near copies, shared passages."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijkéß", k=r.randint(1, 7))) for _ in range(300)]
    words = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = words(60)
    out = [(i, words(r.randint(1, 300)).capitalize() + ".\n" + words(r.randint(0, 80)) + ". " + words(5), f"s{i % 5}" if i % 11 else None) for i in range(120)]
    out += [(200 + i, out[i % 3][1], "s0") for i in range(30)]
    out += [(300 + i, words(25) + " " + passage + "\t" + words(25), "s0") for i in range(10)]
    out += [(400 + i, out[5][1].replace(" ", "  ", i), "s1") for i in range(4)]
    out += [(500, "", "s2"), (501, None, "s2"), (502, " \n\t ", None), (503, "x" * 30_000, "s3"), (504, words(9000), "s4"), (None, words(50), "s0"), (None, None, None)]
    out += [(600, passage, "s0")] * 3
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make_docs(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, [])
