"""Scans along a chromosome in blocks, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals

RANGE = "i long, seqnames string, start long, end long, strand string"


@pytest.fixture(scope="module", params=[1, 2])
def ranges(spark, request):
    """Short ranges in clusters, some empty, and one as long as the chromosome."""
    r = random.Random(request.param)
    rows = []
    for i in range(400):
        s = r.choice([r.randint(1, 60), r.randint(1, 3_000), r.randint(2_950, 3_000)])
        rows.append((i, r.choice(["1", "1", "2"]), s, s + r.choice([-1, 0, 0, 5, 40]), r.choice("++-*")))
    if request.param == 2:
        rows.append((400, "1", 1, 3_100, "-"))
    return rows, spark.createDataFrame(rows, RANGE)


def groups(rows, *at):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in at), []).append(r)
    return out.items()


@pytest.mark.parametrize("block", [7, 100, intervals.BLOCK])
def test_reduce(ranges, block):
    rows, df = ranges
    want = set()
    for (c, s), group in groups(rows, 1, 4):
        islands = []
        for _, _, a, b, _ in sorted(group, key=lambda r: r[2:4]):
            if islands and a <= islands[-1][1] + 1:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        want |= {(c, s, a, b) for a, b in islands}
    assert {tuple(r) for r in intervals.reduce_ranges(df, block=block).collect()} == want


@pytest.mark.parametrize("block", [7, 100, intervals.BLOCK])
def test_segments(ranges, block):
    rows, df = ranges
    want = set()
    for (c, s), group in groups(rows, 1, 4):
        cuts = sorted({r[2] for r in group} | {r[3] + 1 for r in group})
        want |= {(c, s, a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)}
    got = intervals.disjoint_segments(df, block=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [7, 100, intervals.BLOCK])
def test_depth(ranges, block):
    rows, df = ranges
    want = {}
    for (c,), group in groups(rows, 1):
        for _, _, a, b, _ in group:
            for p in range(a, b + 1):
                want[c, p] = want.get((c, p), 0) + 1
    got = {}
    for c, a, b, n in intervals.coverage_runs(df, block=block).collect():
        for p in range(a, b + 1):
            assert (c, p) not in got
            got[c, p] = n
    assert got == want


def nearest(x, subjects, ahead, ignore):
    best = []
    for i, c, a, b, strand in subjects:
        if c != x[1]:
            continue
        for lane in "+" if ignore else "+-":
            if not ignore and (strand not in (lane, "*") or x[4] not in (lane, "*")):
                continue
            after = (lane == "+") == ahead
            if a > x[3] if after else b < x[2]:
                best.append((max(a, x[2]) - min(b, x[3]) - 1, i if ahead else -i))
    return (min(best)[0], abs(min(best)[1])) if best else None


@pytest.mark.parametrize("block", [7, 500, intervals.BLOCK])
@pytest.mark.parametrize("ignore", [False, True])
def test_precede_and_follow(ranges, block, ignore):
    rows, df = ranges
    x, subjects = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    for ahead, f in ((True, intervals.precede), (False, intervals.follow)):
        got = {r["i"]: (r["distance"], r["hit"]["i"]) for r in f(df.where("i % 3 <> 0"), df.where("i % 3 = 0"), "i", ignore, block).collect()}
        assert got == {r[0]: n for r in x if (n := nearest(r, subjects, ahead, ignore))}


def test_one_chromosome_is_many_tasks(spark):
    """No window holds more than a block's positions, wherever the rows are."""
    n, block = 40_000, 1_000
    df = spark.range(n).select(F.col("id").alias("i"), F.lit("1").alias("seqnames"), (F.col("id") * 7919 % n + 1).alias("start"), (F.col("id") * 7919 % n + 30).alias("end"), F.lit("+").alias("strand"))
    assert intervals.coverage_runs(df, block=block).agg(F.sum((F.col("end") - F.col("start") + 1) * F.col("depth"))).first()[0] == n * 30
    assert [tuple(r) for r in intervals.reduce_ranges(df, block=block).collect()] == [("1", "+", 1, n + 29)]
    plan = intervals.coverage_runs(df, block=block)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("block" in line for line in windows)


def _rows_made(df, name, other, bin_width=intervals.BIN, side=1):
    left = intervals._levelled(df, name, 0, bin_width, ())
    return intervals._dealt(left, name, intervals._met(intervals._levelled(other, "o", 0, bin_width, ())), bin_width, side).count()


def test_long_ranges_make_few_rows(spark):
    """A range as long as a chromosome against short ones: rows a level, not a bin."""
    short = spark.range(2_000).select(F.col("id").alias("i"), F.lit("1").alias("seqnames"), (F.col("id") * 120_000 + 1).alias("start"), (F.col("id") * 120_000 + 90).alias("end"), F.lit("+").alias("strand"))
    long = spark.createDataFrame([(7, "1", 1, 240_000_000, "+"), (8, "1", 1_000_000, 1_200_000, "-")], RANGE)
    assert _rows_made(long, "l", short) <= 12
    assert _rows_made(short, "l", short) <= 2 * 2_000
    assert _rows_made(short, "r", long, side=2) <= 2 * 2 * 2_000
    pairs = intervals.overlap_pairs(long, short, ignore_strand=True)
    assert pairs.count() == 2_000 + short.where("start <= 1200000 AND end >= 1000000").count()


@pytest.mark.parametrize("how", [{}, {"maxgap": 12}, {"minoverlap": 4}, {"kind": "start", "maxgap": 3}, {"kind": "end", "maxgap": 3}, {"kind": "within"}, {"kind": "equal"}, {"ignore_strand": True}])
def test_levels_match_naive(spark, how):
    """Ranges of all lengths, empty ones and ones beyond the last level's width."""
    r = random.Random(9)
    rows = [(i, r.choice("12"), s, s + r.choice([-1, 0, 3, 30, 300, 3_000, 30_000, 400_000]), r.choice("++-*")) for i in range(300) for s in [r.randint(1, 300_000)]]
    df = spark.createDataFrame(rows, RANGE)
    x, y = df.where("i % 2 = 0"), df.where("i % 2 = 1").select("seqnames", "start", "end", "strand", F.col("i").alias("j"))
    pairs = lambda found: sorted((p[0], p[1]) for p in found.select("l.i", "r.j").collect())
    want = pairs(intervals.naive_pairs(x, y, **how))
    assert pairs(intervals.overlap_pairs(x, y, bin_width=2, **how)) == pairs(intervals.overlap_pairs(x, y, bin_width=64, **how)) == want


def test_pile_on_one_locus(spark):
    """Reads piled on one place make one row each."""
    pile = spark.range(20_000).select(F.col("id").alias("i"), F.lit("1").alias("seqnames"), F.lit(5_000_000).cast("long").alias("start"), F.lit(5_000_099).cast("long").alias("end"), F.lit("*").alias("strand"))
    exon = spark.createDataFrame([(1, "1", 5_000_050, 5_000_150, "+"), (2, "1", 1, 90_000_000, "-")], RANGE)
    assert _rows_made(pile, "l", exon) == 40_000  # at the level of each exon once
    assert intervals.overlap_pairs(pile, exon).count() == 40_000


@pytest.mark.parametrize("bin_width", [7, 64, intervals.BIN])
def test_segments_a_range_covers(spark, ranges, bin_width):
    """Every range with each segment it covers, over any number of bins; empty
    ranges cut and cover nothing, ranges without a place do neither."""
    rows, df = ranges
    want = []
    for _, group in groups(rows, 1, 4):
        cuts = sorted({p for r in group for p in (r[2], r[3] + 1)})
        want += [(i, a, b - 1) for i, _, s, e, _ in group for a, b in zip(cuts, cuts[1:], strict=False) if s <= a and b - 1 <= e]
    odd = spark.createDataFrame([(900, None, 1, 9, "+"), (901, "1", None, 9, "+"), (902, "2", 3, 9, None)], RANGE)
    got = intervals.covered_segments(df.union(odd), bin_width).select("i", "seg start", "seg end").collect()
    assert sorted(map(tuple, got)) == sorted(want)
