"""Small tables with the awkward rows every operator must bear."""

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose, near and exact copies, nulls, empty and long texts, repeated rows, two null ids."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(r.randint(1, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 160)))
        rows.append((k, text.capitalize() + ".", "en", f"s{k % 7}", len(text)))
    base = " ".join(r.choice(words) for _ in range(400))
    for k in range(n, n + 12):
        rows.append((k, base + (f" tail{k}" if k % 3 else ""), "en", "s0", 1))
    rows += [(n + 20, None, "en", "s1", 0), (n + 21, "", "en", None, 0), (n + 22, " \t\n\x0b\x0c\r ", None, "s2", 7), (n + 23, "Één! dès l'été", "fr", "s3", 3)]
    rows += [(n + 24, " ".join(r.choice(words) for _ in range(9000)), "en", "s4", 5), (n + 25, "x" * 30000, "en", "s4", 5)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s5", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def clashing(df):
    """The same rows with further columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    names = ["id", "fp", "size", "key", "n", "m", "s", "copies", "items", "runs", "base", "part", "start", "slot", "shard", "label", "cell", "side", "root", "segments", "conv", "turns", "n_words", "score"]
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


def as_set(df, *columns):
    """Rows of a result as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
