import random
from pathlib import Path

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, `a.b` string"


def make_docs(spark, rows):
    """rows of (doc_id, text): a documents table with columns whose names clash with the operators' own."""
    data = [(i, t, "en", "s", None if t is None else len(t), 5, "x") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice(["ka", "to", "mé", "ri", "ñu", "lo", "ß", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and very long texts, ties, copies, near copies, and other scripts."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(60), say(300)
    near = base.split()
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "漢字 тест 🙂 ﬁ"), (6, say(20000)), (7, base), (8, base), (9, base.upper())]
    rows += [(10 + k, " ".join([*near[:k], "zz", *near[k + 1 :]])) for k in range(8)]
    rows += [(30 + k, f"{say(40)} {passage} {say(30)}") for k in range(5)]
    rows += [(40, "ab" * 400), (41, "x" * 1000), (42, "\n".join([say(25)] * 6)), (None, say(50)), (None, base), (50, "▁a ▁▁b"), (51, "<|endoftext|>x <s>"), (7, base)]
    return rows


@pytest.fixture()
def written(spark, tmp_path):
    """Writes documents (and other tables) as a data folder and gives its path."""

    def write(rows, **tables):
        make_docs(spark, rows).write.parquet(str(Path(tmp_path) / "documents.parquet"))
        for name, df in tables.items():
            df.write.parquet(str(Path(tmp_path) / f"{name}.parquet"))
        return str(tmp_path)

    return write
