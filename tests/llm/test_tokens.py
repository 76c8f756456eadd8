import zlib

import numpy as np
import pytest
import xxhash

from corpuscope.llm import registry, tokens
from corpuscope.llm.common import new_path

from .conftest import documents


def text_hash(text):
    """Spark's xxhash64 of a string."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


HARD = ["L'été, D'ABORD! ÇA;va x's 'tis don't. Ünï-code?! ÷×ª J\u030C e\u0301 ß... a1b2 c--", "", None, "It's  a test\x1cof spaces\r\n\x85 İstanbul ΣΑΣ é <|endoftext|> 12,34 日本語", "a" * 30_000, "x y " * 20_000, "dup", "dup", " \n\t "]


@pytest.mark.parametrize("shards", [None, 3])
def test_round_trip_equals_whole_text_encoding(spark, shards):
    docs = documents(spark, [*HARD, "same id", "other"], doc_id=[8, 3, 1, 2, 9, 4, 7, 7, None, 5, 5])
    out = new_path(spark, "t")
    tokens.write_tokens(docs.withColumn("ids", docs.doc_id), out, registry.tokenizer_path(), 2, 49_408, shards)
    got = [tuple(r) for r in tokens.scan_tokens(spark, out).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    out = new_path(spark, "t")
    assert tokens.write_tokens(documents(spark, []), out, registry.tokenizer_path(), 2).count() == 0
    assert tokens.scan_tokens(spark, out, with_ids=True).collect() == []


def test_query_on_whole_texts(spark, store, prose):
    docs = documents(spark, [prose(50 + i, i) + "!?" * (i % 5) for i in range(60)])
    got = registry.op1_token_output(spark, store(documents=docs)).collect()
    assert [tuple(r) for r in sorted(got)] == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [t for t in HARD if t and len(t) < 1000] + ["two words  and\nlines\n"]
    out = new_path(spark, "t")
    tokens.write_tokens(documents(spark, texts), out, path, 50_256, 50_257)
    got = {r.doc_id: r.ids for r in tokens.scan_tokens(spark, out, with_ids=True).collect()}
    assert got == {i: [*whole.encode(t, add_special_tokens=False).ids, 50_256] for i, t in enumerate(texts)}
    assert not tokens.Encoder(path, 0, "<u2").parted and tokens.Encoder(registry.tokenizer_path(), 2, "<u2").direct


def test_a_shard_is_written_piece_by_piece(spark, prose, monkeypatch):
    """One shard over many Arrow batches."""
    monkeypatch.setitem(__import__("corpuscope.llm.common", fromlist=["BATCH"]).BATCH, "spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [prose(5 + i % 9, i) for i in range(100)]
    out = new_path(spark, "t")
    tokens.write_tokens(documents(spark, texts), out, registry.tokenizer_path(), 2, 49_408, 1)
    got = sorted((tuple(r) for r in tokens.scan_tokens(spark, out).collect()), key=lambda r: r[1])
    assert got == expected(list(enumerate(texts)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
