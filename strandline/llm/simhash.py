"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most two bits,
cut into two segments of 32, have a segment in which they differ in at most one
bit. So each distinct fingerprint is indexed under the one-wildcard variants of
both segments (the segment with one bit blanked, and which bit that was), an
equality join on the variants finds every such pair, and the exact distance
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import written
from strandline.llm.graph import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_BLOCK = 1 << 15


def normal_words(text: str | None) -> bytes:
    """UTF-8 of the words, A-Z lower-cased, with single spaces between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def simhash(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the k-word shingles, repeats included.

    Fewer than k words are one shingle; no words at all give 0.
    """
    return simhash_of(normal_words(text), k)


def simhash_of(data: bytes, k: int = SHINGLE_WORDS) -> int:
    """The same from ``normal_words`` of a text."""
    if not data:
        return 0
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    n = len(spaces) + 1
    if n <= k:
        return xxhash.xxh64_intdigest(data, SEED)
    starts = [0, *(spaces[: n - k] + 1).tolist()]
    ends = [*spaces[k - 1 :].tolist(), len(data)]
    digest, seed, over = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = np.array([digest(data[i:j], seed) for i, j in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and ``fp``: its fingerprint as a signed long."""
    keep = list(keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py(), k) for t in batch.column(0)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*keep, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])
    return docs.select(F.col("text").alias("fp text"), *keep).mapInArrow(apply, schema)


def _low_mask(bits: int) -> int:
    return (1 << bits) - 1


def _wildcards(value: Column, width: int, tag: int) -> Column:
    """The one-wildcard variants of a ``width``-bit value, as longs that also
    tell the segment (``tag``) and the blanked bit apart."""
    keys = [value.bitwiseAND(F.lit(_low_mask(width) ^ (1 << j))).bitwiseOR(F.lit((tag << 40) | (j << 34))) for j in range(width)]
    return F.array(*keys)


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(_low_mask(width)))


def variants(fps: DataFrame) -> DataFrame:
    """Rows (key, fp): the 64 deletion variants of every distinct fingerprint."""
    both = F.concat(*[_wildcards(_segment(F.col("fp"), 32 * s, 32), 32, s) for s in range(2)])
    return fps.select("fp", F.explode(both).alias("key"))


def links(fps: DataFrame, bucket: int = 256) -> DataFrame:
    """Distinct pairs (a, b), a < b, of distinct fingerprints ``fps`` that differ
    in at most two bits.

    Keys that two fingerprints share need no join: their least and greatest
    members are the pair. Only fuller keys are joined. Keys of more than
    ``bucket`` fingerprints (near copies by the thousand) are cut again: within
    them the other segment differs in at most two bits, so one of its halves
    differs in at most one, and the same wildcard step on the halves splits the
    key exactly. No pair is lost and no key is capped.
    """
    keys = fps.transform(variants)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    groups = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-keys")
    pairs = groups.where("n = 2").where(near).select("a", "b")

    full = keys.join(groups.where(F.col("n") > 2).select("key", "n"), "key")
    other = F.expr("shiftrightunsigned(fp, CAST(32 - 32 * shiftright(key, 40) AS INT))").bitwiseAND(F.lit(_low_mask(32)))
    halves = F.concat(*[_wildcards(F.shiftrightunsigned(F.col("other"), 16 * h).bitwiseAND(F.lit(0xFFFF)), 16, h) for h in range(2)])
    small = full.where(F.col("n") <= bucket).select("key", F.lit(-1).cast("long").alias("part"), "fp")
    large = full.where(F.col("n") > bucket).withColumn("other", other).select("key", F.explode(halves).alias("part"), "fp")
    dealt = written(small.union(large), "simhash-full")
    x, y = dealt.withColumnRenamed("fp", "a"), dealt.withColumnRenamed("fp", "b")
    joined = x.join(y, ["key", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    return pairs.union(joined).distinct()


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """The rows of ``distinct`` (one a fingerprint, ``fp``) with ``component``, the
    least fingerprint reachable over links; its own where there is none."""
    linked = components(links(distinct.select("fp")), "a", "b", "simhash-links")
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fp`` (signed long), ``fingerprint``
    (16 hex digits) and ``component_id``, the least doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows stay, one result row each. Null doc_ids take part in links and get the
    component's least doc_id, or null if the component has none. Other columns
    are ignored. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, k), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    member = fingerprint_components(distinct)
    root = member.groupBy("component").agg(F.min("least").alias("component_id"))
    # a written table, so that a fingerprint of many copies can be split over tasks
    label = written(member.join(root, "component").select("fp", "component_id"), "simhash-labels")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(label, "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id.

    Of several rows with that doc_id the least by all columns stays; a component
    without any doc_id keeps one row.
    """
    names = docs.columns
    found = near_duplicates(docs, k)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("first")).where("first")
    ids = ids.select(F.col("doc_id").alias("kept_id"), ((F.col("n") == 1) & F.col("doc_id").isNotNull()).alias("alone"))
    ids = written(ids, "simhash-kept")
    alone = ids.where("alone").hint("shuffle_hash")
    kept = docs.join(alone, docs["doc_id"] == alone["kept_id"], "left_semi")
    shared = ids.where("NOT alone")
    if shared.isEmpty():
        return kept
    rest = docs.join(shared, docs["doc_id"].eqNullSafe(shared["kept_id"]), "left_semi")
    root = found.select("fp", "component_id").distinct().withColumnsRenamed({"fp": "root fp", "component_id": "root id"})
    # a row travels as one struct, so that columns of any name are safe
    of = fingerprints(rest.select("text", F.struct(*names).alias("row")), k, ("row",))
    of = of.join(root, F.col("fp") == F.col("root fp")).where(F.col("row.doc_id").eqNullSafe(F.col("root id")))
    key = F.coalesce(F.col("root id").cast("string"), F.concat(F.lit("fp "), F.col("fp")))
    return kept.union(of.groupBy(key).agg(F.min("row").alias("row")).select("row.*"))
