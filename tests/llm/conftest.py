import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, `row` int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdethrsn") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts = [*base, *base[:10], base[3], base[3], base[3]]
    texts += [" ".join(t.split()[:-1] + ["changed"]) for t in base[:25] if len(t.split()) > 60]
    texts += [None, None, "", " ", "\t\n", "x", "É x", "<|endoftext|> a", words(rng, 20_000), "z" * 30_000, "a  b \n c", "\U0001f600 中文"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "é", "b2", None]), None, 1, "s", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[3], None, None, None, 1, "s", 2), (None, "only", None, "a", None, 1, "s", 2)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
