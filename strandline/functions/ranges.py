"""Column functions for ranges and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and their complements (fixed values).
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def width(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start) + 1


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Positions between two ranges: 0 if adjacent, negative if they overlap."""
    return F.greatest(s1, s2) - F.least(e1, e2) - 1


def strands_agree(a: Column, b: Column, ignore_strand: bool = False) -> Column:
    if ignore_strand:
        return F.lit(True)
    return (a == b) | (a == "*") | (b == "*")


def div(a: Column, b: int) -> Column:
    """Floor division of longs, without a detour over doubles."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def promoter(start: Column, end: Column, strand: Column, upstream: int, downstream: int) -> tuple[Column, Column]:
    """Around the transcription start; not trimmed to the chromosome."""
    minus = strand == "-"
    return F.when(minus, end - downstream + 1).otherwise(start - upstream), F.when(minus, end + upstream).otherwise(start + downstream - 1)


def terminator(start: Column, end: Column, strand: Column, upstream: int, downstream: int) -> tuple[Column, Column]:
    """Around the transcription end; not trimmed to the chromosome."""
    minus = strand == "-"
    return F.when(minus, start - downstream + 1).otherwise(end - upstream), F.when(minus, start + upstream).otherwise(end + downstream - 1)


def dense_ids(df: DataFrame, keys: list[str], group: list[str], position: str, block: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """Distinct ``keys`` with ``id``: their dense rank by keys, which begin with
    ``group`` and ``position``.

    Ranks are counted inside blocks of positions and shifted by the blocks'
    totals, so only the block totals (a few rows a chromosome) meet in one task.
    Rows are dealt by block before they are made distinct: that one exchange
    serves the distinct rows, their ranks and the totals. ``parts`` fixes its number
    of tasks, which otherwise follows packed bytes: those of ids are a small part of
    what a task sorts. Rows without a group or position have no id.
    """
    rows = df.select(*keys).withColumn("block", div(F.col(position), block))
    for c in (*group, "block"):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.repartition(*([parts] if parts else []), *group, "block").distinct()
    within = Window.partitionBy(*group, "block").orderBy(*keys)
    totals = rows.groupBy(*group, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*group, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = rows.withColumn("nth", F.row_number().over(within)).join(starts, [*group, "block"])
    return ranked.select(*keys, (F.col("nth") + F.col("shift")).cast("long").alias("id"))
