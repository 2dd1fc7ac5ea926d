"""Read coverage along transcripts, as runs in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.coords import in_transcription_order
from strandline.operators.intervals import CORE, coverage_runs, overlap_pairs


def merged_seqinfo(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two dictionaries of chromosomes (seqnames, seqlengths, isCircular, genome,
    rank) as one: what one lacks comes from the other, ``a``'s order goes first.
    What both have and tell differently is an error when it is read."""
    far = b.select(F.col("seqnames"), *[F.col(c).alias(f"b_{c}") for c in ("seqlengths", "isCircular", "genome", "rank")])
    both = a.join(far, "seqnames", "full")

    def agreed(c: str) -> Column:
        clash = F.raise_error(F.concat(F.lit(f"{c} differ for "), "seqnames")).cast(a.schema[c].dataType)
        return F.when(F.col(c).isNotNull() & F.col(f"b_{c}").isNotNull() & (F.col(c) != F.col(f"b_{c}")), clash).otherwise(F.coalesce(c, f"b_{c}")).alias(c)

    place = F.struct(F.col("rank").isNull(), F.coalesce("rank", "b_rank"))
    ranked = both.select("seqnames", *[agreed(c) for c in ("seqlengths", "isCircular", "genome")], place.alias("place"))
    return ranked.select("seqnames", "seqlengths", "isCircular", "genome", F.row_number().over(Window.orderBy("place")).alias("rank"))


def seqlengths(chrominfo: DataFrame, *ranges: DataFrame) -> DataFrame:
    """(seqnames, length): the known length, or else the last position seen, at
    least 0; null for a chromosome without ranges. ``chrominfo`` has chrom and
    length, or is a seqinfo."""
    seen = ranges[0].select("seqnames", "end")
    for r in ranges[1:]:
        seen = seen.union(r.select("seqnames", "end"))
    last = seen.groupBy("seqnames").agg(F.greatest(F.max("end"), F.lit(0)).alias("last"))
    names = ("chrom", "length") if "chrom" in chrominfo.columns else ("seqnames", "seqlengths")
    known = chrominfo.select(F.col(names[0]).alias("seqnames"), F.col(names[1]).alias("length"))
    return known.join(last, "seqnames", "full").select("seqnames", F.coalesce("length", "last").alias("length"))


def trimmed(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranges cut to their chromosome; those that lie outside it go. A chromosome
    that is unknown, or of unknown length, has no end. One row a chromosome is
    broadcast."""
    known = lengths.select(F.col("seqnames").alias("on"), F.col("length").alias("stop"))
    rows = ranges.join(F.broadcast(known), F.col("seqnames") == F.col("on"), "left")
    cut = rows.withColumns({"start": F.greatest("start", F.lit(1).cast("long")), "end": F.least("end", F.coalesce("stop", "end"))})
    return cut.where("end >= start").select(*ranges.columns)


def _stranded(reads: DataFrame, ignore_strand: bool) -> DataFrame:
    """Unstranded reads count on both strands."""
    strands = F.array(F.lit("*")) if ignore_strand else F.when(F.col("strand") == "*", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))
    return reads.withColumn("strand", F.explode(strands))


def _runs_in_transcripts(runs: DataFrame, exons: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Covered pieces in transcript coordinates. Distinct exons are matched once
    and their pieces handed to all transcripts that have them."""
    ordered = in_transcription_order(exons)
    ranges = ordered.select(*on, *CORE).distinct()
    pairs = overlap_pairs(runs, ranges, on=on).where("l.strand = r.strand")
    pieces = pairs.select(*[F.col(f"r.{c}").alias(c) for c in (*on, *CORE)], F.greatest("l.start", "r.start").alias("s"), F.least("l.end", "r.end").alias("e"), "l.depth")
    rows = ordered.join(pieces, [*on, *CORE])
    minus = F.col("strand") == "-"
    a = F.col("off") + F.when(minus, F.col("end") - F.col("e") + 1).otherwise(F.col("s") - F.col("start") + 1)
    return rows.select("group_id", a.alias("start"), (a + F.col("e") - F.col("s")).alias("end"), "depth")


def _filled(pieces: DataFrame, exons: DataFrame) -> DataFrame:
    """Uncovered stretches get depth 0 and equal neighbours become one run. The
    pieces are read once and dealt to transcripts once."""
    totals = exons.groupBy("group_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("total"))
    stop = totals.select("group_id", (F.col("total") + 1).alias("start"), F.col("total").alias("end"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("stop"))
    order = Window.partitionBy("group_id").orderBy("start", "end")
    rows = pieces.select("group_id", "start", "end", "depth", F.lit(False).alias("stop")).union(stop).withColumn("before", F.coalesce(F.lag("end").over(order), F.lit(0)) + 1)
    zero = F.struct(F.col("before").alias("start"), (F.col("start") - 1).alias("end"), F.lit(0).cast("long").alias("depth"))
    both = F.array_compact(F.array(F.when(F.col("start") > F.col("before"), zero), F.when(~F.col("stop"), F.struct("start", "end", "depth"))))
    every = rows.select("group_id", F.explode(both).alias("x")).select("group_id", "x.*")
    order = Window.partitionBy("group_id").orderBy("start")
    new = F.when(F.lag("depth").over(order) == F.col("depth"), 0).otherwise(1)
    run = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = every.withColumn("new", new).withColumn("run", run).groupBy("group_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth"))
    return merged.select("group_id", "start", "end", "depth")


def coverage_by_transcript(reads: DataFrame, exons: DataFrame, ignore_strand: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """Runs (group_id, start, end, depth) that tile every transcript from 1 to
    its width. Unstranded exons are an error unless strands are ignored. Where
    ``lengths`` (seqnames, length) are given, reads count inside them only."""
    reads = reads if lengths is None else trimmed(reads, lengths)
    if ignore_strand:
        # positions still count in transcription order, but depth is shared
        runs = coverage_runs(reads).select("seqnames", "start", "end", F.explode(F.array(F.lit("+"), F.lit("-"), F.lit("*"))).alias("strand"), "depth")
    else:
        if not exons.where("strand = '*'").isEmpty():
            raise ValueError("unstranded exons need ignore_strand=True")
        runs = coverage_runs(_stranded(reads, False), ("seqnames", "strand"))
    return _filled(_runs_in_transcripts(runs, exons, ()), exons)


def pcoverage_by_transcript(reads: DataFrame, exons: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """The same where each read counts only for its paired transcript: both sides
    carry ``i``."""
    if ignore_strand:
        runs = coverage_runs(reads, ("i", "seqnames")).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"), F.lit("*"))))
    else:
        runs = coverage_runs(_stranded(reads, False), ("i", "seqnames", "strand"))
    return _filled(_runs_in_transcripts(runs, exons, ("i",)), exons)
