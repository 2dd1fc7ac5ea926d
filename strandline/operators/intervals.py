"""Interval kernels: overlap joins, reduce, disjoin, gaps, coverage runs.

Ranges are DataFrames with seqnames, start, end, strand and any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.ranges import div, gap, strands_agree

BIN = 16_384
#: Levels of bins, and how much wider each is: 16 kb, 256 kb, 4 Mb, 64 Mb, 1 Gb.
LEVELS, LEVEL_STEP = 5, 16
#: Positions of one block of a scan along a chromosome: the rows of a task's window.
BLOCK = 1 << 18
CORE = ("seqnames", "start", "end", "strand")
_UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def _matches(s1: Column, e1: Column, s2: Column, e2: Column, kind: str, maxgap: int, minoverlap: int) -> Column:
    wide = (e1 >= s1) & (e2 >= s2)
    some = F.lit(True) if minoverlap <= 0 else (F.least(e1, e2) - F.greatest(s1, s2) + 1 >= minoverlap)
    slack = max(maxgap, 0)
    any_ = (gap(s1, e1, s2, e2) < 0) & wide if maxgap < 0 else gap(s1, e1, s2, e2) <= maxgap
    if kind == "any":
        return any_ & some
    if kind == "start":
        return (F.abs(s1 - s2) <= slack) & some
    if kind == "end":
        return (F.abs(e1 - e2) <= slack) & some
    if kind == "within":
        return (s1 >= s2) & (e1 <= e2) & some
    if kind == "equal":
        return (F.abs(s1 - s2) <= slack) & (F.abs(e1 - e2) <= slack) & some
    raise ValueError(f"unknown overlap type: {kind}")


def _level(length: Column, bin_width: int) -> Column:
    """The finest level whose bins are as long as a range; such a range touches
    two bins of its level at most."""
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= bin_width * LEVEL_STEP**k, k).otherwise(level)
    return level


def _levelled(df: DataFrame, name: str, grow: int, bin_width: int, on: tuple[str, ...]) -> DataFrame:
    low, high = F.col("start") - grow, F.greatest("start", "end") + grow
    return df.select(F.struct(*df.columns).alias(name), F.col("seqnames"), *on, low.alias("low"), high.alias("high"), _level(high - low + 1, bin_width).alias("own"))


def _met(df: DataFrame) -> DataFrame:
    """By level: whether the side has ranges of it, and shorter ones. A row a level."""
    up = df.select("own").distinct().select("own", F.explode(F.sequence("own", F.lit(LEVELS - 1))).alias("level"))
    return up.groupBy("level").agg(F.max(F.col("own") == F.col("level")).alias("has"), F.max(F.col("own") < F.col("level")).alias("shorter"))


def _dealt(df: DataFrame, name: str, met: DataFrame, bin_width: int, side: int) -> DataFrame:
    """Rows by (level, kind, bin). Kind 0 is for pairs of one level; 1 and 2 for
    pairs at the level of the left or right range, the other being shorter."""
    rows = df.withColumn("level", F.explode(F.sequence("own", F.lit(LEVELS - 1)))).join(F.broadcast(met), "level")
    mine = F.col("level") == F.col("own")
    kinds = F.array(F.when(mine & F.col("has"), 0), F.when(mine & F.col("shorter"), side), F.when(~mine & F.col("has"), 3 - side))
    rows = rows.withColumn("kind", F.explode(F.array_compact(kinds)))
    size = F.element_at(F.array(*[F.lit(bin_width * LEVEL_STEP**k).cast("long") for k in range(LEVELS)]), (F.col("level") + 1).cast("int"))
    at = lambda c: ((c - F.pmod(c, size)) / size).cast("long")
    return rows.withColumns({f"{name}_first": at(F.col("low")), "last": at(F.col("high"))}).withColumn("bin", F.explode(F.sequence(f"{name}_first", "last"))).drop("low", "high", "own", "last", "has", "shorter")


def overlap_pairs(left: DataFrame, right: DataFrame, kind: str = "any", maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False, bin_width: int = BIN, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of overlapping ranges: struct columns ``l`` and ``r``.

    Bins come in levels, each LEVEL_STEP times as wide as the one below. A pair
    meets at the level of its longer range, where both touch one bin or two, so
    the join is an equality, a chromosome is spread over many tasks, and a range
    as long as a chromosome makes a row or two a level, not one for every bin.
    Levels that the other side has not got make no rows; which it has is a table
    of a row a level. The left side is widened by the gap allowed; a pair is kept
    only in the first bin both touch. Adaptive execution splits bins that a pile
    of ranges makes hot. ``on``: further columns that must be equal.
    """
    a, b = _levelled(left, "l", max(maxgap, 0) + 1, bin_width, on), _levelled(right, "r", 0, bin_width, on)
    pairs = _dealt(a, "l", _met(b), bin_width, 1).join(_dealt(b, "r", _met(a), bin_width, 2), ["seqnames", "level", "kind", "bin", *on])
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    return pairs.where(
        (F.col("bin") == F.greatest("l_first", "r_first"))
        & _matches(l("start"), l("end"), r("start"), r("end"), kind, maxgap, minoverlap)
        & strands_agree(l("strand"), r("strand"), ignore_strand)
    ).select("l", "r")


def naive_pairs(left: DataFrame, right: DataFrame, kind: str = "any", maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False) -> DataFrame:
    """The same pairs by comparing whole chromosomes; a check on the binned form."""
    a, b = left.select(F.struct(*left.columns).alias("l")), right.select(F.struct(*right.columns).alias("r"))
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    cond = _matches(l("start"), l("end"), r("start"), r("end"), kind, maxgap, minoverlap) & strands_agree(l("strand"), r("strand"), ignore_strand)
    return a.join(b, (l("seqnames") == r("seqnames")) & cond)


def subset_by_overlaps(x: DataFrame, ranges: DataFrame, key: str, **how) -> DataFrame:
    """Rows of ``x`` that overlap any range; ``key`` identifies a row of ``x``."""
    hit = overlap_pairs(x.select(key, *CORE), ranges.select(*CORE), **how).select(F.col(f"l.{key}").alias(key)).distinct()
    return x.join(hit, key, "left_semi")


def _in_blocks(rows: DataFrame, by: tuple[str, ...], position: str, block: int) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """``rows`` with ``block``, and the windows of a block and of all blocks
    before one. What a scan along a group needs of earlier blocks is a small
    table of one row a block, so no task holds more than a block's positions."""
    own = Window.partitionBy(*by, "block")
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(*_UP_TO_BEFORE)
    return rows.withColumn("block", div(F.col(position), block)), own, earlier


def _carry(rows: DataFrame, by: tuple[str, ...], handed: DataFrame) -> DataFrame:
    """The rows with what their block was handed, joined on what the windows are
    dealt by, so that large tables are shuffled once for both."""
    return rows.join(handed, [*by, "block"])


def reduce_ranges(df: DataFrame, by: tuple[str, ...] = ("seqnames", "strand"), block: int = BLOCK) -> DataFrame:
    """Overlapping and adjacent ranges of a group made one (gaps and islands).

    Ranges with the same start count once. A block is handed the highest end
    before it, and the start of the island that was open there."""
    tops = df.groupBy(*by, "start").agg(F.max("end").alias("end"))
    rows, own, earlier = _in_blocks(tops, by, "start", block)
    highest = rows.groupBy(*by, "block").agg(F.max("end").alias("top"))
    rows = _carry(rows, by, highest.select(*by, "block", F.max("top").over(earlier).alias("above")))
    order = own.orderBy("start")
    top = F.greatest("above", F.max("end").over(order.rowsBetween(*_UP_TO_BEFORE)))
    opens = F.when(top.isNull() | (F.col("start") > top + 1), F.col("start"))
    rows = rows.withColumn("opens", opens).drop("above")
    opened = rows.groupBy(*by, "block").agg(F.max("opens").alias("latest"))
    rows = _carry(rows, by, opened.select(*by, "block", F.max("latest").over(earlier).alias("before")))
    island = F.coalesce(F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("before"))
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.max("end").alias("end")).select(*by, F.col("island").alias("start"), "end")


def _stops(rows: DataFrame, by: tuple[str, ...], block: int, more: tuple[Column, ...] = (), handed: tuple[Column, ...] = ()) -> tuple[DataFrame, WindowSpec]:
    """Distinct ``pos`` with ``stop``, the position before the next one; the last
    of a block gets it from the next block. ``more`` are sums over a block,
    ``handed`` what to make of those of the blocks before."""
    rows, own, _ = _in_blocks(rows, by, "pos", block)
    heads = rows.groupBy(*by, "block").agg(F.min("pos").alias("head"), *more)
    after = F.lead("head").over(Window.partitionBy(*by).orderBy("block"))
    rows = _carry(rows, by, heads.select(*by, "block", after.alias("after"), *handed))
    order = own.orderBy("pos")
    return rows.withColumn("stop", F.coalesce(F.lead("pos").over(order), F.col("after")) - 1), order


def disjoint_segments(df: DataFrame, by: tuple[str, ...] = ("seqnames", "strand"), block: int = BLOCK) -> DataFrame:
    """Segments between neighbouring range borders, gaps included."""
    cuts = df.select(*by, F.col("start").alias("pos")).union(df.select(*by, (F.col("end") + 1).alias("pos"))).distinct()
    rows, _ = _stops(cuts, by, block)
    return rows.where("stop IS NOT NULL").select(*by, F.col("pos").alias("start"), F.col("stop").alias("end"))


def covered_segments(df: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Every range once for each segment of the disjoint union that it covers: the
    columns of ``df`` with ``seg bin``, ``seg start`` and ``seg end``. Ranges of
    different strands never meet.

    A range goes to the bins it touches, and so do all that cut it there: the
    cuts of a bin are collected where its ranges lie, and a range takes those
    between its borders. Ranges are dealt once; grouping by seqnames, strand and
    ``seg bin`` needs no further exchange. The next cut behind a bin comes from a
    table of one row a bin. Bins without cuts make no rows.
    """
    key = ["seqnames", "strand", "seg bin"]
    df = df.where(" AND ".join(f"{c} IS NOT NULL" for c in CORE))
    at = lambda c: div(c, bin_width)
    stop = F.col("end") + 1
    cuts = df.select(*key[:2], F.explode(F.array("start", stop)).alias("pos"))
    heads = cuts.groupBy(*key[:2], at(F.col("pos")).alias(key[2])).agg(F.min("pos").alias("head"))
    heads = heads.select(*key, F.lead("head").over(Window.partitionBy(*key[:2]).orderBy(key[2])).alias("seg after"))
    own = Window.partitionBy(*key)
    here = lambda c: F.when(at(c) == F.col(key[2]), c)
    borders = [F.collect_set(here(c)).over(own) for c in (F.col("start"), stop)]
    rows = df.withColumn(key[2], F.explode(F.sequence(at(F.col("start")), at(stop))))
    rows = rows.withColumn("seg cuts", F.sort_array(F.array_union(*borders))).where("end >= start").join(heads, key)
    nth = lambda c, otherwise: F.coalesce(F.array_position("seg cuts", here(c)).cast("int"), otherwise)
    rows = rows.withColumns({"seg i": nth(F.col("start"), F.lit(1)), "seg j": nth(stop, F.size("seg cuts") + 1)})
    n = F.col("seg j") - F.col("seg i")
    ends = F.concat(F.slice("seg cuts", F.col("seg i") + 1, n), F.when(F.col("seg j") > F.size("seg cuts"), F.array("seg after")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("seg", F.explode(F.arrays_zip(F.slice("seg cuts", F.col("seg i"), n).alias("s"), ends.alias("e"))))
    return rows.select(*df.columns, key[2], F.col("seg.s").alias("seg start"), (F.col("seg.e") - 1).alias("seg end"))


def disjoin(df: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Struct pairs ``l`` (segment of the disjoint union) and ``r`` (a range that
    covers it); gaps vanish. Ranges of different strands never meet."""
    segment = F.struct("seqnames", F.col("seg start").alias("start"), F.col("seg end").alias("end"), "strand")
    return covered_segments(df, bin_width).select(segment.alias("l"), F.struct(*df.columns).alias("r"))


def coverage_runs(df: DataFrame, by: tuple[str, ...] = ("seqnames",), block: int = BLOCK) -> DataFrame:
    """Runs (start, end, depth) of positions that a range covers.

    Steps at a position are summed before they are dealt to blocks; a block is
    handed the depth at its border."""
    steps = df.select(*by, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("step")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).cast("long").alias("step")))).alias("x"))
    steps = steps.groupBy(*by, F.col("x.pos").alias("pos")).agg(F.sum("x.step").alias("step"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(*_UP_TO_BEFORE)
    rows, order = _stops(steps, by, block, (F.sum("step").alias("total"),), (F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("depth0"),))
    depth = F.col("depth0") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = rows.select(*by, F.col("pos").alias("start"), F.col("stop").alias("end"), depth.alias("depth"))
    return runs.where("depth > 0 AND end >= start")


def overall_range(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _latest(x: DataFrame, subject: DataFrame, on: tuple[str, ...], last: bool, block: int) -> DataFrame:
    """Rows of ``x`` with ``hit``, the subject with the highest ``at`` that is not
    above theirs. Subjects at one place are one candidate: the last or first by
    ``s``, a struct.

    An as-of search: distinct places of both sides ride one sorted window per
    block, the subject carried forward; a block is handed the last subject
    before it. No pair is formed, and a place with many rows is searched once."""
    pick = F.max if last else F.min
    kind = subject.schema["s"].dataType
    s = subject.groupBy(*on, "at").agg(pick("s").alias("s"))
    asked = x.select(*on, "at").distinct()
    both = s.select(*on, "at", F.lit(0).alias("kind"), "s").union(asked.select(*on, "at", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("s")))
    rows, own, earlier = _in_blocks(both, on, "at", block)
    lasts = rows.groupBy(*on, "block").agg(F.max_by("s", F.when(F.col("kind") == 0, F.col("at"))).alias("s"))
    rows = _carry(rows, on, lasts.select(*on, "block", F.last("s", ignorenulls=True).over(earlier).alias("handed")))
    order = own.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("hit", F.coalesce(F.last("s", ignorenulls=True).over(order), F.col("handed"))).where("kind = 1 AND hit IS NOT NULL")
    return x.join(found.select(*on, "at", "hit"), [*on, "at"])


def nearest_before(x: DataFrame, subject: DataFrame, on: tuple[str, ...] = ("seqnames",), block: int = BLOCK) -> DataFrame:
    """For each row of ``x`` (key ``i``) the subject that ends last before it,
    strands ignored: i, and ``hit`` (struct); of several the greatest row."""
    s = subject.select(*on, F.col("end").alias("at"), F.struct(*subject.columns).alias("s"))
    return _latest(x.select("i", *on, (F.col("start") - 1).alias("at")), s, on, True, block).select("i", "hit")


def nearest_after(x: DataFrame, subject: DataFrame, on: tuple[str, ...] = ("seqnames",), block: int = BLOCK) -> DataFrame:
    """For each row of ``x`` (key ``i``) the subject that starts first after it,
    strands ignored; of several the least row."""
    s = subject.select(*on, (-F.col("start")).alias("at"), F.struct(*subject.columns).alias("s"))
    return _latest(x.select("i", *on, (-F.col("end") - 1).alias("at")), s, on, False, block).select("i", "hit")


def _neighbour(x: DataFrame, subject: DataFrame, order: str, ahead: bool, ignore_strand: bool, block: int) -> DataFrame:
    """Lanes: on ``+`` transcription runs up, on ``-`` down; an unstranded range
    is on both. ``at`` falls with the direction of the search."""
    lane = F.explode(F.array(F.lit("+"))) if ignore_strand else F.explode(F.when(F.col("strand") == "*", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand")))
    up = (F.col("lane") == "+") == F.lit(ahead)
    on = ("seqnames", "lane")
    s = subject.withColumn("lane", lane).select(*on, F.when(up, -F.col("start")).otherwise(F.col("end")).alias("at"), F.struct(F.col(order).alias("order"), F.struct(*subject.columns).alias("row")).alias("s"))
    q = x.select("i", "seqnames", "start", "end", "strand").withColumn("lane", lane).select("i", *on, F.when(up, -F.col("end") - 1).otherwise(F.col("start") - 1).alias("at"), "start", "end")
    hits = _latest(q, s, on, not ahead, block)
    away = gap(F.col("start"), F.col("end"), F.col("hit.row.start"), F.col("hit.row.end"))
    rows = hits.select("i", away.alias("distance"), F.col("hit.order").alias("order"), F.col("hit.row").alias("hit"))
    if ignore_strand:
        return rows.select("i", "distance", "hit")
    # an unstranded range may have a hit on each lane: the nearer, ties by the rule of the search
    nearest = rows.groupBy("i").agg(F.min("distance").alias("distance"), F.min_by(F.struct("order", "hit"), F.struct("distance", "order")).alias("first"), F.max_by(F.struct("order", "hit"), F.struct(-F.col("distance"), F.col("order"))).alias("last"))
    return nearest.select("i", "distance", F.col("first.hit" if ahead else "last.hit").alias("hit"))


def precede(x: DataFrame, subject: DataFrame, order: str, ignore_strand: bool = False, block: int = BLOCK) -> DataFrame:
    """For each row of ``x`` (key ``i``) the nearest subject that it comes before
    in the direction of transcription: i, distance (0 if they touch), hit.

    A range on ``+`` meets subjects on ``+`` and ``*``, one on ``-`` those on
    ``-`` and ``*`` the other way round, an unstranded one both, and takes the
    nearer. Ties go to the first by ``order``, a column of the subjects. Ranges
    without a hit have no row. Ignoring strands counts all as ``+``."""
    return _neighbour(x, subject, order, True, ignore_strand, block)


def follow(x: DataFrame, subject: DataFrame, order: str, ignore_strand: bool = False, block: int = BLOCK) -> DataFrame:
    """The mirror image: the nearest subject that ``x`` comes behind; ties go to
    the last by ``order``."""
    return _neighbour(x, subject, order, False, ignore_strand, block)
