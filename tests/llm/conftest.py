import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, n_words long, text_key long, hash long, row int, key long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(
        rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split())
        + rng.choice(["", "", ",", "s", str(rng.randrange(40))]) for _ in range(n)
    )


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "Two words", "a b c", words(rng, 60), words(rng, 60), words(rng, 20_000)]
    shared = "This line is shared by many documents of a host."
    texts += [shared + "\n" + words(rng, 70) for _ in range(40)]
    texts += [shared + "\nshort tail here"]
    texts += ["x y z " * 40]
    rows = [(i, t, "en", f"src{i % 2}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    near = words(rng, 400)
    rows += [(100, near, None, "src0", len(near)), (101, near + " end", "en", "src0", len(near) + 4), (102, near, "en", "src1", None)]
    rows += [
        rows[6], rows[6], (6, "same id, other text", "en", "src0", 19), (None, "no id here", "en", "src0", 10),
        (None, None, None, None, None)
    ]
    return [(*r, "x", None, 7, 8, None, 3, 9) for r in rows]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
