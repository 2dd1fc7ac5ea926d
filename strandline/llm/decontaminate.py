"""Benchmark items inside documents: size-partitioned MinHash containment.

Containment of a short item in a long document is hopeless for plain MinHash
bands, as their Jaccard similarity is near zero. So only the items are sketched,
by size class: class c has the items of 2^c to 2^(c+1) - 1 shingles. A match may
miss a fifth of an item's shingles, at most ``missed(c)`` in the class. Items of
the class keep their missed(c) + HITS[c] least hashes, so a match has HITS[c] of
them at least. Documents look up all their shingles in the sketches by an
equality join; those with enough hits are verified on the shingles themselves.

The sketch table is broadcast only where a count shows that it is small, and
shuffled otherwise. Documents meet their candidates by key, so no text passes
through the driver, and no row of the benchmark does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import written
from strandline.llm.shingles import Words

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Least sketch rows that a match shares, by size class: small items have none to
#: spare, larger ones are told from a common phrase by more than one.
HITS = (1, 1, 1, 2, 2, 3)
#: Most rows of the sketch table (two longs and an int each) in one broadcast.
BROADCAST_ROWS = 1_000_000


def needed(n: int, containment: float) -> int:
    """Least number of an item's n shingles that a match shares."""
    return max(1, math.ceil(containment * n - 1e-9))


def size_class(n: int) -> int:
    """Items of 2^c to 2^(c+1) - 1 shingles are one partition."""
    return n.bit_length() - 1


def sketch_size(c: int, containment: float) -> int:
    """Hashes that the items of class ``c`` keep."""
    most = (2 << c) - 1
    return most - needed(most, containment) + HITS[min(c, len(HITS) - 1)]


def items(benchmark: DataFrame, k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """item (the text's hash), text, class, width, ``hits`` (least sketch rows of
    a match) and ``sketch`` of every distinct text that has words."""
    schema = "item long, text string, class int, width int, hits int, sketch array<long>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Words(text)
                if not len(words):
                    continue
                width = min(k, len(words))
                hashes = np.unique(words.windows(width))
                n = len(hashes)
                sketch = hashes[: sketch_size(size_class(n), containment)]
                hits = max(1, len(sketch) - (n - needed(n, containment)))
                rows.append((item, text, size_class(n), width, hits, sketch.view(np.int64).tolist()))
            if rows:
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["item", "text", "class", "width", "hits", "sketch"])

    texts = benchmark.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("item"), "text").distinct()
    return written(texts.mapInArrow(apply, schema), "leak-items")


def _lookups(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_hash, width and ``hash`` of every distinct shingle."""
    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", long), T.StructField("width", T.IntegerType()), T.StructField("hashes", T.ArrayType(long))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                words = [Words(t) for t in part.column(2).to_pylist()]
                for width in widths:
                    found = [w.windows(width).view(np.int64) for w in words]
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.full(len(part), width, np.int32)), lists], schema.names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(apply, schema)
    return rows.select("doc_id", "text_hash", "width", F.explode("hashes").alias("hash"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, item of the pairs that share enough sketch rows."""
    sketch = written(known.select("item", "hits", "width", F.explode("sketch").alias("hash")), "leak-sketch")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # SHINGLE_WORDS rows at most
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    met = _lookups(docs, widths).join(sketch, ["width", "hash"]).select("doc_id", "text_hash", "item", "hits", "hash").distinct()
    return met.groupBy("doc_id", "text_hash", "item", "hits").agg(F.count(F.lit(1)).alias("n")).where("n >= hits").select("doc_id", "text_hash", "item")


def verified(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, item, n_shared, n_item of every match, one row for each
    row of ``docs`` with it."""
    known = items(benchmark, k, containment)
    found = candidates(docs, known).join(known.select("item", F.struct("item", "text").alias("x")), "item")
    by_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_list("x").alias("xs")).withColumnsRenamed({"doc_id": "c id", "text_hash": "c hash"})
    by_doc = written(by_doc, "leak-candidates")
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    near = d.join(by_doc, F.col("doc_id").eqNullSafe(F.col("c id")) & (F.col("text_hash") == F.col("c hash"))).select("doc_id", "text_hash", "text", "xs")
    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, long) for c in ("text_hash", "item", "n_shared", "n_item"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth in range(batch.num_rows):
                words, own = Words(batch.column(2)[nth].as_py()), {}
                for x in batch.column(3)[nth].as_py():
                    item = Words(x["text"])
                    width = min(k, len(item))
                    if width not in own:
                        own[width] = words.window_set(width) if len(words) >= width else set()
                    theirs = item.window_set(width)
                    if (shared := len(theirs & own[width])) >= needed(len(theirs), containment):
                        rows.append((nth, x["item"], shared, len(theirs)))
            if rows:
                nth, *rest = zip(*rows, strict=True)
                ids = [batch.column(c).take(pa.array(nth)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, pa.int64()) for c in rest]], schema.names)

    return near.mapInArrow(apply, schema)


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each row of
    ``docs`` and item of which the document has 0.8 or more of the shingles.

    Shingles are distinct windows of five words, A-Z lower-cased; an item of
    fewer words is one shingle of all its words. Null and empty texts match
    nothing; null ids are reported as null; repeated rows give repeated results;
    very long texts are looked up whole; other columns are ignored; an empty
    table gives an empty result.
    """
    found = verified(docs, benchmark, k, containment)
    ids = benchmark.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("item"), "item_id")
    return found.join(ids, "item").select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay, whatever
    their names. Other rows are treated as by ``contaminations``."""
    dirty = verified(docs, benchmark, k, containment).select(F.col("doc_id").alias("dirty id"), F.col("text_hash").alias("dirty hash")).distinct()
    dirty = written(dirty, "leak-dirty")
    return docs.join(dirty, docs["doc_id"].eqNullSafe(F.col("dirty id")) & (F.xxhash64(docs["text"]) == F.col("dirty hash")), "left_anti")
