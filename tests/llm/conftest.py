import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice("abcdefgh") + draw.choice("aeiou") + str(draw.randrange(400)) for _ in range(n)]


def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    passage = prose(1, 70)
    base = prose(2, 120)
    near = list(base)
    near[60] = "changed"
    far = [w if k % 4 else "other" + str(k) for k, w in enumerate(base)]
    texts = [
        " ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(), None, "", " \t\n", "one", "ONE", "two words",
        " ".join(prose(3, 30) + passage + prose(4, 20)), " ".join(prose(5, 3) + passage + prose(6, 9)), "\n".join(passage),
        " ".join(prose(7, 6000)), "x" * 300_000, "é" * 10 + " ünï " * 30, "line a b\nline a b\n\nline a b c d e f g h\n",
        " ".join(base), " ".join(passage[:50]), " ".join(passage[:49]),
        "# * $ % & | < > symbols everywhere # # # # # and more words here to pass ten",
    ]
    rows = [(k, t, "en", None if k == 3 else f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[10], (None, " ".join(base), "en", "src0", None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "size", "shard", "slot", "part", "row", "spans", "n_words", "component_id", "kept", "id", "h1", "label", "start"]
    return docs.withColumns({n: F.lit("x") for n in names})
