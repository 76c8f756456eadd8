"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

The rows are dealt by ranges of doc_id; each task encodes its range and writes one shard:
`NNNNNN.ids` (the ids of its documents one after another, unsigned 16 or 32 bits, little endian),
`NNNNNN.off` (n + 1 offsets in ids from the shard's begin, unsigned 64 bits) and `NNNNNN.doc`
(n doc_ids, 64 bits; the null mask in `NNNNNN.nul`, one byte each). A document's place in the
whole output is its offset plus the shard's base, a prefix sum over the shards' totals, which the
manifest (a Parquet table beside the shards) holds. Reading maps the files into memory.

Ids are written as they are encoded, so a shard can be larger than a worker's memory. Files appear by a rename
after they are whole, with the same bytes at each attempt, so a task that runs again, or twice at once, does no harm.

Defined results: null text encodes as empty; each document ends with the end id, so an empty one has
one id. Null doc_ids come first; repeated doc_ids are ordered by a hash of the text. An empty table gives no shard.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from array import array
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import small_batches

#: Words whose ids a worker remembers (about 250 bytes each): so many new ones, and so many of those before.
CACHE_WORDS = 250_000


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if urlsplit(uri).scheme == "file":
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


class _Sink:
    """A file that is written piece by piece under another name, and has its own once it is whole."""

    def __init__(self, uri: str):
        self.store, self.path = _place(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)

    def finish(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def _put(uri: str, data: bytes) -> None:
    sink = _Sink(uri)
    sink.out.write(data)
    sink.finish()


def _map(uri: str, dtype: str) -> np.ndarray:
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


#: Latin letters of one code point each, then ASCII marks without the apostrophe: parts that this kind of tokenizer always cuts apart.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level models write a byte that isn't printable in Latin 1 as a code point from U+0100 on, in order.
_BYTES = {b: 0x100 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_PROBES = ("the", "Words", "straße.", "Él,", "garçon!?", "x##", "ÿÀ;", "counterrevolutionaries-")
#: Texts whose ids must be those of their parts between white space, or a tokenizer gets whole texts.
_SPACED = ("two words", "  lead and  trail ", "a\tb\nc\r\nd", "Don't stop, 12 34.5 !", "naïve É ß\x0bx\x0cy", "日本 語 x", " ", "a b c " * 20, "e\u0301 \u0301 x", "<|endoftext|> x")


class Encoder(dict):
    """Encodes whole texts; remembers the ids of words.

    A text is cut at ASCII white space, if probes show that the tokenizer drops white space and never joins
    characters across it, so that the parts' ids are the text's ids, as with the word-level one here; any other
    tokenizer gets whole texts. Words of Latin letters with marks behind them go to the tokenizer's model
    directly, if probes show that this gives the same ids; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs tasks side by side; threads of one's own would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__()
        self.before: dict[bytes, bytes] = {}
        self.code = np.dtype(dtype).char
        self.end = array(self.code, [end_id]).tobytes()
        self.model = self.tokenizer.model
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.parted = all(ids(t) == [i for part in t.encode().split() for i in ids(part.decode())] for t in _SPACED)
        self.direct = self.parted and all(self._direct(_PLAIN.fullmatch(w)) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES)

    def _direct(self, parts: re.Match) -> list[int]:
        head, marks = parts.groups()
        head = head.lower()
        if not head.isascii():
            head = head.encode().decode("latin-1").translate(_BYTES)
        found = self.model.tokenize(head)
        if marks:
            found += self.model.tokenize(marks)
        return [t.id for t in found]

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            parts = _PLAIN.fullmatch(text) if self.direct else None
            ids = self._direct(parts) if parts else self.tokenizer.encode(text, add_special_tokens=False).ids
            found = array(self.code, ids).tobytes()
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text and the end id, as bytes."""
        if not text:
            return self.end
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        if not self.parted:
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split())) + self.end  # bytes part at ASCII white space only


@functools.lru_cache(1)
def _encoder(path: str, end_id: int, dtype: str) -> Encoder:
    """One for a worker process, which runs many tasks."""
    return Encoder(path, end_id, dtype)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, vocab: int = 1 << 16, shards: int | None = None) -> DataFrame:
    """Writes docs to shards under the URI out and returns the manifest: shard, n_docs, n_ids, base (ids before it), dtype."""
    spark = docs.sparkSession
    small_batches(spark)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    order = ["doc_id", "text_hash"]  # short keys, as a sample of them goes to the driver
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ranged = docs.repartitionByRange(shards, *order) if shards else docs.repartitionByRange(*order)

    def write(batches):
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _encoder(tokenizer, end_id, dtype).encode
        name, sinks, n_docs, n_ids = f"{out}/{shard:06d}", None, 0, 0
        for batch in batches:
            if sinks is None:
                sinks = {kind: _Sink(f"{name}.{kind}") for kind in ("ids", "off", "doc", "nul")}
                sinks["off"].out.write(np.zeros(1, "<u8").tobytes())
            lengths = []
            for text in batch.column(1):
                data = encode(text.as_py())
                sinks["ids"].out.write(data)
                lengths.append(len(data) // np.dtype(dtype).itemsize)
            offsets = n_ids + np.cumsum(lengths, dtype="<u8")
            column = batch.column(0).cast(pa.int64())
            sinks["off"].out.write(offsets.astype("<u8").tobytes())
            sinks["doc"].out.write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            sinks["nul"].out.write(column.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            n_docs, n_ids = n_docs + len(lengths), int(offsets[-1]) if len(lengths) else n_ids
        if sinks is None:
            return
        for sink in sinks.values():
            sink.finish()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    store, path = _place(out)
    store.create_dir(path, recursive=True)
    ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, "shard long, n_docs long, n_ids long").write.parquet(f"{out}/totals")
    totals = spark.read.schema("shard long, n_docs long, n_ids long").parquet(f"{out}/totals")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    manifest = totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("dtype", F.lit(dtype))
    manifest.write.parquet(f"{out}/manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("shard long, n_docs long, n_ids long, base long, dtype string").parquet(f"{out}/manifest")


def scan_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Reads the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 over the ids as unsigned 32-bit integers, and the ids if wanted."""
    shards = read_manifest(spark, out)
    shards = shards.repartition(max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism)), "shard")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{out}/{row['shard']:06d}"
                ids, offsets, docs, nulls = (_map(f"{name}.{x}", d) for x, d in (("ids", row["dtype"]), ("off", "<u8"), ("doc", "<i8"), ("nul", "u1")))
                for at in range(0, len(docs), 5000):
                    some = [ids[a:b].astype("<u4") for a, b in zip(offsets[at : at + 5000], offsets[at + 1 : at + 5001])]
                    columns = [
                        pa.array(docs[at : at + 5000], pa.int64(), mask=nulls[at : at + 5000] != 0),
                        pa.array(row["base"] + offsets[at : at + len(some)].astype("i8"), pa.int64()),
                        pa.array([len(x) for x in some], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in some], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype("i8") for x in some], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
