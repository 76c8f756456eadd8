import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """A documents table of the given texts; doc_id counts from 0 unless given."""
    ids = columns.get("doc_id", range(len(texts)))
    lang, source = columns.get("lang", ["en"] * len(texts)), columns.get("source", ["a"] * len(texts))
    return spark.createDataFrame([(i, t, la, s, len(t) if t else 0) for i, t, la, s in zip(ids, texts, lang, source)], DOCS)


@pytest.fixture
def prose():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocab, k=n))


@pytest.fixture
def store(tmp_path):
    """Writes tables as <folder>/<name>.parquet and returns the folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
