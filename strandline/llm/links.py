"""Links between similar sets that share a bucket, without joining it with itself.

Every bucket has a hub, the member that meets the most others over all its
buckets, and every member is compared with it. What links is folded into
components. A bucket whose members are all of one component is done: nothing in
it can join anything, and of groups of copies next to nothing is left.

The others are settled exactly:

* What a member has in common with other components bounds its overlap with any
  of their members. Where that is too little for the bucket's least size it goes,
  by one count over the open members' elements, not one for each bucket.
* Buckets with the same members are one.
* Only pairs of two components matter, so one of the two is outside the bucket's
  commonest component. Outsiders are cut in chunks and all members in blocks, of
  MOST rows and WEIGHT elements on average; each chunk meets each block in one
  group. A bucket of no more than that is one group.
* In a group a member is compared with all of other components at once, those of
  the commonest last, and what links is folded before the next one. So a group
  makes no pairs, and takes time by its outsiders and its elements.

All links inside buckets are found; what the bands miss is the only loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import dropped, written
from strandline.llm.graph import components

SIMILARITY = 0.8
_SLACK = 1e-9
#: Members, and elements of their sets, of a chunk or a block.
MOST, WEIGHT = 1024, 1 << 20


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    a, b = sets.select(F.col("key").alias("a"), F.col("set").alias("a set")), sets.select(F.col("key").alias("b"), F.col("set").alias("b set"))
    both = F.size(F.array_intersect("a set", "b set"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("a set") + F.size("b set")).alias("sizes"))
    return rows.where(F.col("both") >= SIMILARITY * (F.col("sizes") - F.col("both")) - _SLACK).select("a", "b")


def _open(now: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Rows of ``now`` (bucket, key, size, component) that may still be similar to
    a member of another component in their bucket. What goes takes its elements
    from the others, so it is told again while that drops a tenth of the rows."""
    before = None
    while True:
        mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least"))
        after = written(now.join(mixed.where("low <> high").select("bucket", "least"), "bucket"), f"{name}-mixed")
        dropped(now)
        n = after.count()
        if not n or before is not None and n > 0.9 * before:
            return after
        each = after.select("key", "component").distinct().join(sets, "key").select("key", "component", F.explode("set").alias("element"))
        common = each.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("element")
        shares = written(each.join(common.hint("merge"), "element").groupBy("key").agg(F.count(F.lit(1)).alias("shares")), f"{name}-shares")
        needs = F.greatest(SIMILARITY * F.col("size"), SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("least"))) - _SLACK
        now = written(after.join(shares, "key", "left").where(F.coalesce("shares", F.lit(0)) >= needs).drop("shares", "least"), f"{name}-open")
        for old in (after, shares):
            dropped(old)
        before = n


def forest(component: np.ndarray, sizes: np.ndarray, elements: np.ndarray) -> list[tuple[int, int]]:
    """Links (places of two sets) that join what similar sets join, of sets that
    lie end to end in ``elements``; sets of one component are not compared."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, value, count = np.unique(elements, return_inverse=True, return_counts=True)
    # what stands in one set alone is in no intersection
    common = count[value] > 1
    row, value = row[common], value[common]
    edge = np.searchsorted(row, np.arange(n + 1))
    fame = np.bincount(row, count[value], n)
    _, component = np.unique(component, return_inverse=True)
    ahead = np.lexsort((np.arange(n), -fame))
    todo, mark, links = np.ones(n, bool), np.zeros(len(count), bool), []
    while True:
        left = np.bincount(component[todo])
        if np.count_nonzero(left) < 2:
            return links
        outside = todo[ahead] & (component[ahead] != left.argmax())
        i = ahead[outside.argmax()]
        todo[i] = False
        others = todo & (component != component[i]) & (sizes >= SIMILARITY * sizes[i] - _SLACK) & (SIMILARITY * sizes <= sizes[i] + _SLACK)
        if not others.any():
            continue
        own, near = value[edge[i] : edge[i + 1]], others[row]
        mark[own] = True
        both = np.bincount(row[near], mark[value[near]], n)
        mark[own] = False
        linked = np.flatnonzero(others & (both >= SIMILARITY * (sizes + sizes[i] - both) - _SLACK))
        joined, first = np.unique(component[linked], return_index=True)
        links += [(i, j) for j in linked[first].tolist()]
        component[np.isin(component, joined)] = component[i]


def _settled(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the groups in ``rows`` (group, key, component, set)."""

    def solved(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        keys, component, sizes, elements = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        found = np.array(forest(component, sizes, elements), np.int64).reshape(-1, 2)
        return keys[found[:, 0]], keys[found[:, 1]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None
        for batch in batches:
            group, key, component = (batch.column(k).to_numpy() for k in range(3))
            ends, elements, made = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy(), []
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if parts and group[i] != at:
                    made.append(solved(parts))
                    parts = []
                at = group[i]
                parts.append((key[i:j], component[i:j], np.diff(ends[i : j + 1]).astype(np.int64), elements[ends[i] : ends[j]]))
            parts = [tuple(np.array(x) for x in p) for p in parts]  # the batch's memory goes
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], ["a", "b"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in solved(parts)], ["a", "b"])

    return rows.select("group", "key", "component", "set").repartition("group").sortWithinPartitions("group").mapInArrow(apply, "a long, b long")


def _grouped(left: DataFrame) -> DataFrame:
    """group, key and component from bucket, key, size and component: every pair
    of a bucket of which one is outside its commonest component is in a group."""
    part = left.groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.xxhash64("key"))).alias("y")
    )
    whole = part.groupBy("bucket").agg(F.max(F.struct("n", "w", "component")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    whole = whole.groupBy("n", "w", "x", "y").agg(F.min(F.struct("bucket", "main")).alias("b")).select("b.*", "n", "w")
    cuts = lambda n, w: F.greatest(F.lit(1), F.ceil(n / MOST), F.ceil(w / WEIGHT)).cast("int")
    one = (F.col("n") <= 2 * MOST) & (F.col("w") <= 2 * WEIGHT)
    few = cuts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w"))
    whole = whole.select("bucket", F.col("main.component").alias("main"), F.when(one, 1).otherwise(few).alias("chunks"), F.when(one, 1).otherwise(cuts(F.col("n"), F.col("w"))).alias("blocks"))
    rows = left.join(whole, "bucket")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n, salt: F.array(F.pmod(F.xxhash64("key", F.lit(salt)), n).cast("int"))
    in_block = rows.select("bucket", "key", "component", every("chunks").alias("chunk"), place("blocks", 0).alias("block"))
    large = rows.where("chunks > 1 OR blocks > 1").where(F.col("component") != F.col("main"))
    in_chunk = large.select("bucket", "key", "component", place("chunks", 1).alias("chunk"), every("blocks").alias("block"))
    dealt = in_block.union(in_chunk).withColumn("chunk", F.explode("chunk")).withColumn("block", F.explode("block"))
    return dealt.select(F.xxhash64("bucket", "chunk", "block").alias("group"), "key", "component").distinct()


def similar_links(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Component labels of the members: key, ``component``, for linked keys only.

    ``members``: bucket (long), key (long), distinct. ``sets``: key and ``set``, an
    array of longs, each once; keys are unique.
    """
    crowds = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    fame = members.join(crowds, "bucket").groupBy("key").agg(F.sum("n").alias("fame"))
    sized = written(members.join(sets.select("key", F.size("set").alias("size")).join(fame, "key"), "key"), f"{name}-sized")
    hubs = sized.groupBy("bucket").agg(F.max_by("key", F.struct("fame", "key")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = sized.join(hubs, "bucket").where("key <> hub").select(F.greatest("hub", "key").alias("a"), F.least("hub", "key").alias("b")).distinct()
    links = written(_compared(pairs, sets), f"{name}-links")
    labels = written(components(links, "a", "b", f"{name}-components"), f"{name}-labels")
    now = sized.drop("fame").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    left = _open(now, sets, name)
    more = written(_settled(_grouped(left).join(sets, "key")), f"{name}-more")
    if not more.isEmpty():
        labels = written(components(links.union(more), "a", "b", f"{name}-components"), f"{name}-labels")
    for old in (sized, links, left, more):
        dropped(old)
    return labels.withColumnRenamed("node", "key")
