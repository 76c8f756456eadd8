"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item is cut into windows of `width` consecutive words; an item of fewer words is one
window. All windows of one length form one matcher: its shift table tells, from the block of the
last two words, how many positions can be skipped; where the shift is 0, the buckets of that block
and of the window's first block select the test windows, and a direct comparison confirms them.

Defined results: null text or text without words: no words, no hits. Repeated document rows give a
row each. A benchmark row with null text or no word has no window. Items that share a window are
all reported. A null item_id is reported as the string "null". Extra columns are passed over.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, small_batches

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, parts words elsewhere.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Words of benchmark windows that one broadcast holds (about 100 bytes each); beyond it, further passes over the documents.
WINDOW_WORDS_PER_PASS = 2_000_000

_RESULT = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_ARROW = [("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class WuManber:
    """Finds windows that all have the same number of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.m = m = len(next(iter(windows)))
        self.b = b = min(2, m)
        self.most = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]] = {}
        for window, items in windows.items():
            for end in range(b, m + 1):
                block = b" ".join(window[end - b : end])
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            prefixes = self.buckets.setdefault(b" ".join(window[m - b :]), {})
            prefixes.setdefault(b" ".join(window[:b]), []).append((list(window), items))

    def find(self, words: list[bytes]):
        """Yields (start, items) of every occurrence."""
        m, b, most, shift, buckets = self.m, self.b, self.most, self.shift.get, self.buckets
        i, n = m - 1, len(words)
        while i < n:
            block = words[i - 1] + b" " + words[i] if b == 2 else words[i]
            step = shift(block, most)
            if step:
                i += step
                continue
            start = i - m + 1
            first = words[start] + b" " + words[start + 1] if b == 2 else words[start]
            for window, items in buckets[block].get(first, ()):
                if words[start : i + 1] == window:
                    yield start, items
            i += 1


def matchers(rows, width: int) -> list[WuManber]:
    """One matcher for each window length among the (item_id, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in rows:
        item = "null" if item is None else str(item)
        for window in windows_of(words_of(text), width):
            found = by_length.setdefault(len(window), {}).setdefault(window, [])
            if item not in found:
                found.append(item)
    return [WuManber(by_length[m]) for m in sorted(by_length)]


def search(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], list[str]]:
    """The hit words as disjoint ascending spans, and the items found."""
    spans, items = [], set()
    for table in tables:
        for start, found in table.find(words):
            spans.append((start, start + table.m))
            items.update(found)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, sorted(items)


def _parts(benchmark: DataFrame, width: int, most: int):
    """Lists of (item_id, text) rows, each of a bounded number of window words, one at a time; a list without rows if there is none."""
    part, held, any_before = [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        part.append((row[0], row[1]))
        held += width * (len(row[1] or "") // 2 + 1)
        if held >= most * 4:
            yield part
            part, held, any_before = [], 0, True
    if part or not any_before:
        yield part


_built: dict[str, list[WuManber]] = {}


def _tables(name: str, sent, width: int) -> list[WuManber]:
    """The matchers of a part, which a worker builds once for all its tasks; it holds those of one part only."""
    if name not in _built:
        _built.clear()
        _built[name] = matchers(sent.value, width)
    return _built[name]


def _pass(docs: DataFrame, sent, width: int) -> DataFrame:
    small_batches(docs.sparkSession)
    name = uuid.uuid4().hex
    names = docs.columns
    at = names.index("text")

    def run(batches):
        tables = _tables(name, sent, width)
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                spans, found = search(words, tables)
                counts.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(found)
            keep = [c for i, c in enumerate(batch.columns) if i != at]
            kept = [n for i, n in enumerate(names) if i != at]
            new = [pa.array(x, kind) for x, (_, kind) in zip((counts, hits, items), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(keep + new, names=kept + [n for n, _ in _ARROW])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, {_RESULT}" if fields else _RESULT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, words_per_pass: int = WINDOW_WORDS_PER_PASS) -> DataFrame:
    """doc_id, n_words, hits (disjoint spans of word positions), items (sorted as strings): one row for each row of docs.

    The benchmark is streamed to the driver in parts of a bounded number of window words; each part
    is broadcast, searched in one pass and given up before the next one comes. With more than one part, hits of the passes are united by document row.
    """
    docs = docs.select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    parts = _parts(benchmark, width, words_per_pass)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _pass(docs, sc.broadcast(first), width)
    keyed = materialize(docs.withColumn("row_key", F.expr("uuid()")), "decontaminate-docs")
    passes = []
    for part in itertools.chain((first, second), parts):
        sent = sc.broadcast(part)
        passes.append(materialize(_pass(keyed, sent, width), "decontaminate-hits"))
        sent.destroy()
    every = functools.reduce(DataFrame.unionByName, passes)
    merged = every.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    joined = F.aggregate(
        F.col("hits"),
        F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), start.alias("open")),
        lambda a, h: F.when(h["start"] <= a["open"]["end"], F.struct(a["done"].alias("done"), F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], h["end"]).alias("end")).alias("open"))).otherwise(
            F.struct(F.array_append(a["done"], a["open"]).alias("done"), h.alias("open"))
        ),
        lambda a: F.filter(F.array_append(a["done"], a["open"]), lambda s: s["end"] > s["start"]),
    )
    return merged.select("doc_id", "n_words", joined.alias("hits"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, words_per_pass: int = WINDOW_WORDS_PER_PASS) -> DataFrame:
    """docs without the rows that hold any window of the benchmark; columns and other rows are untouched. Each part of the benchmark is given up before the next one comes."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    parts = _parts(benchmark, width, words_per_pass)
    part = next(parts)
    while part is not None:
        sent = sc.broadcast(part)

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            tables = _tables(name, sent, width)
            for batch in batches:
                clean = []
                for text in batch.column(at):
                    words = words_of(text.as_py())
                    clean.append(not any(next(t.find(words), None) for t in tables))
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs, part = docs.mapInArrow(run, docs.schema), next(parts, None)
        if part is not None:
            docs = materialize(docs, "decontaminate-docs")
            sent.destroy()
    return docs
