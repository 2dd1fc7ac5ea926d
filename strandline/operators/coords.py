"""Coordinate mapping between genome, transcript and protein space.

Transcripts are grouped exons in long form: group_id, seqnames, start, end,
strand. A position p of exon e is ``off + (p - start + 1)`` in the transcript,
or ``off + (end - p + 1)`` on the minus strand, where ``off`` is the width of
the exons before e in transcription order. Nothing else is needed; ranges map by
their ends. Ranges to map carry ``i``, their place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.ranges import div
from strandline.operators.intervals import overlap_pairs


def in_transcription_order(exons: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """``exons`` with ``off``, ``w`` and ``nth``; the listed order is of no
    account. Ignoring strands counts from the left and makes strands ``*``."""
    if ignore_strand:
        exons = exons.withColumn("strand", F.lit("*"))
    minus = F.col("strand") == "-"
    order = Window.partitionBy("group_id").orderBy(F.when(minus, -F.col("start")).otherwise(F.col("start")), F.when(minus, -F.col("end")).otherwise(F.col("end")))
    w = F.col("end") - F.col("start") + 1
    before = F.coalesce(F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return exons.withColumns({"w": w, "off": before, "nth": F.row_number().over(order)})


def check_strands(exons: DataFrame) -> None:
    """Exons of a transcript on several strands are an error."""
    if not exons.groupBy("group_id").agg(F.countDistinct("strand").alias("n")).where("n > 1").isEmpty():
        raise ValueError("some transcripts have exons on several strands")


def _to_tx(p: Column, e: str) -> Column:
    c = lambda n: F.col(f"{e}.{n}")
    return c("off") + F.when(c("strand") == "-", c("end") - p + 1).otherwise(p - c("start") + 1)


def project_on_transcripts(x: DataFrame, exons: DataFrame, ignore_strand: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """The exonic parts of every range, one row per (range, exon): i, group_id,
    genomic start and end of the part, ``tx_start``, ``tx_end``, strand,
    ``offset_in_exon``."""
    ordered = in_transcription_order(exons, ignore_strand)
    pairs = overlap_pairs(x, ordered, ignore_strand=ignore_strand, on=on)
    s, e = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    a, b = _to_tx(s, "r"), _to_tx(e, "r")
    into = F.when(F.col("r.strand") == "-", F.col("r.end") - e).otherwise(s - F.col("r.start"))
    return pairs.select(
        F.col("l.i").alias("i"), F.col("r.group_id").alias("group_id"), F.col("r.seqnames").alias("seqnames"), s.alias("start"), e.alias("end"), F.col("r.strand").alias("strand"),
        F.least(a, b).alias("tx_start"), F.greatest(a, b).alias("tx_end"), into.alias("offset_in_exon"), (s == F.col("l.start")).alias("at_start"), (e == F.col("l.end")).alias("at_end"), F.col("r.nth").alias("nth"),
    )


def _junctions(x: DataFrame, ordered: DataFrame, ignore_strand: bool, on: tuple[str, ...]) -> DataFrame:
    """Hits of ranges inside an intron: the empty range behind the exon before."""
    order = Window.partitionBy("group_id").orderBy("start", "end")
    after, left = F.lead("start").over(order), F.lead("off").over(order)
    gaps = ordered.withColumns({"next": after, "next_off": left}).where(F.col("next") > F.col("end") + 1)
    at = F.when(F.col("strand") == "-", F.col("off")).otherwise(F.col("next_off"))
    gaps = gaps.select(*on, "group_id", "seqnames", (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end"), "strand", at.alias("at"))
    pairs = overlap_pairs(x, gaps, kind="within", ignore_strand=ignore_strand, on=on)
    return pairs.select(F.col("l.i").alias("i"), F.col("r.group_id").alias("group_id"), (F.col("r.at") + 1).alias("start"), F.col("r.at").alias("end"), F.col("r.strand").alias("strand"), F.lit(True).alias("intronic"))


def map_to_transcripts(x: DataFrame, exons: DataFrame, ignore_strand: bool = False, intron_junctions: bool = False, first_only: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """i, group_id, start, end, strand, intronic: the range of each ``x`` in every
    transcript that has both its ends in exons. ``first_only`` reports a range
    that spans introns in the first such transcript only."""
    parts = project_on_transcripts(x, exons, ignore_strand, on)
    hits = parts.groupBy("i", "group_id", "strand").agg(
        F.min("tx_start").alias("start"), F.max("tx_end").alias("end"), F.max("at_start").alias("s"), F.max("at_end").alias("e"), F.count(F.lit(1)).alias("n")
    ).where("s AND e")
    if first_only:
        first = Window.partitionBy("i")
        hits = hits.withColumn("m", F.min(F.when(F.col("n") > 1, F.col("group_id"))).over(first)).withColumn("inside", F.max(F.col("n") == 1).over(first))
        hits = hits.where("n = 1 OR (NOT inside AND group_id = m)")
    hits = hits.select("i", "group_id", "start", "end", "strand", F.lit(False).alias("intronic"))
    if intron_junctions:
        hits = hits.union(_junctions(x, in_transcription_order(exons, ignore_strand), ignore_strand, on))
    return hits


def pmap_to_transcripts(x: DataFrame, exons: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """The i-th range in the i-th transcript (``exons`` with i and group_id); a
    range that does not map has start 0, end -1 and strand ``*``."""
    hits = map_to_transcripts(x, exons, ignore_strand, on=("i",)).drop("intronic")
    every = x.select("i").join(exons.select("i", "group_id").distinct(), "i")
    out = every.join(hits, ["i", "group_id"], "left")
    return out.select("i", "group_id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("strand", F.lit("*")).alias("strand"))


def _from_tx(ranges: DataFrame, ordered: DataFrame, keys: list[str], ignore_strand: bool) -> DataFrame:
    """Both ends of transcript ranges located in exons: one genomic range each."""
    r, o = ranges.alias("r"), ordered.alias("o")
    # a place is never null, and only a plain equality keeps rows in the buckets they lie in
    cond = [F.col(f"r.{k}") == F.col(f"o.{k}") if k == "i" else F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    hit = lambda t: (t > F.col("o.off")) & (t <= F.col("o.off") + F.col("o.w"))
    rows = r.join(o, cond)
    if not ignore_strand:
        rows = rows.where((F.col("r.strand") == F.col("o.strand")) | (F.col("r.strand") == "*") | (F.col("o.strand") == "*"))
    place = lambda t: F.when(F.col("o.strand") == "-", F.col("o.end") - (t - F.col("o.off") - 1)).otherwise(F.col("o.start") + (t - F.col("o.off") - 1))
    a, b = F.when(hit(F.col("r.start")), place(F.col("r.start"))), F.when(hit(F.col("r.end")), place(F.col("r.end")))
    grouped = rows.groupBy(*[F.col(f"r.{k}").alias(k) for k in dict.fromkeys(["i", *keys])], F.col("o.seqnames").alias("seqnames"), F.col("o.strand").alias("strand")).agg(F.max(a).alias("a"), F.max(b).alias("b"))
    found = grouped.where("a IS NOT NULL AND b IS NOT NULL")
    return found.withColumns({"start": F.least("a", "b"), "end": F.greatest("a", "b")}).drop("a", "b")


def map_from_transcripts(x: DataFrame, exons: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """Genomic ranges of transcript ranges (i, group_id, start, end, strand):
    i, group_id, seqnames, start, end, strand. Paired by name, all duplicates;
    ranges outside the transcript have no row; no common name is an error."""
    if x.join(exons, "group_id", "left_semi").isEmpty():
        raise ValueError("none of the names occurs among the transcripts")
    ordered = in_transcription_order(exons, ignore_strand)
    return _from_tx(x, ordered, ["group_id"], ignore_strand).select("i", "group_id", "seqnames", "start", "end", "strand")


def pmap_from_transcripts(x: DataFrame, exons: DataFrame, ignore_strand: bool = True) -> DataFrame:
    """The i-th transcript range in the i-th transcript, as one genomic range;
    what does not map has seqnames UNMAPPED and width 0."""
    ordered = in_transcription_order(exons)
    x = x if "strand" in x.columns else x.withColumn("strand", F.lit("*"))
    hits = _from_tx(x, ordered, ["i"], ignore_strand).select("i", "seqnames", "start", "end", "strand")
    out = x.select("i").join(hits, "i", "left")
    return out.select("i", F.coalesce("seqnames", F.lit("UNMAPPED")).alias("seqnames"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("strand", F.lit("*")).alias("strand"))


def pmap_from_transcripts_split(x: DataFrame, exons: DataFrame) -> DataFrame:
    """The same, split by exon: one row per exon of the transcript, of width zero
    (end = start - 1) where the range does not reach."""
    whole = pmap_from_transcripts(x, exons).where("seqnames <> 'UNMAPPED'").select("i", F.col("start").alias("s"), F.col("end").alias("e"))
    rows = in_transcription_order(exons).join(whole, "i")
    start, end = F.greatest("start", "s"), F.least("end", "e")
    out = rows.withColumns({"a": start, "b": end})
    return out.select("i", "seqnames", F.when(F.col("b") >= F.col("a"), F.col("a")).otherwise(F.col("start")).alias("start"), F.when(F.col("b") >= F.col("a"), F.col("b")).otherwise(F.col("start") - 1).alias("end"), "strand", "nth")


def recycled(x: DataFrame, n: int, length: int) -> DataFrame:
    """``x`` (with i from 0) repeated to ``length`` rows; only a table of one row
    or of that length will do."""
    if n == length:
        return x
    if n != 1:
        raise ValueError(f"{n} rows do not pair with {length}")
    return x.drop("i").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))


def transcript_locs_to_ref_locs(locs: DataFrame, exons: DataFrame, decreasing_rank_on_minus: bool = False, error_if_out_of_bounds: bool = True) -> DataFrame:
    """Genomic positions of transcript positions. ``locs``: i, group_id, loc;
    ``exons``: group_id, pos (listed order), start, end, strand. Exons of a minus
    strand are listed by rank, or with the option by decreasing rank."""
    order = Window.partitionBy("group_id").orderBy(F.when((F.col("strand") == "-") & F.lit(decreasing_rank_on_minus), -F.col("pos")).otherwise(F.col("pos")))
    w = F.col("end") - F.col("start") + 1
    off = F.coalesce(F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    e = exons.withColumns({"w": w, "off": off}).alias("e")
    inside = (F.col("l.group_id") == F.col("e.group_id")) & (F.col("l.loc") > F.col("e.off")) & (F.col("l.loc") <= F.col("e.off") + F.col("e.w"))
    step = F.col("l.loc") - F.col("e.off") - 1
    ref = F.when(F.col("e.strand") == "-", F.col("e.end") - step).otherwise(F.col("e.start") + step)
    out = locs.alias("l").join(e, inside, "left").select("l.i", "l.group_id", "l.loc", ref.alias("ref"))
    if error_if_out_of_bounds:
        out = out.withColumn("ref", F.when(F.col("ref").isNull(), F.raise_error(F.lit("a location is out of bounds")).cast("long")).otherwise(F.col("ref")))
    return out


def protein_to_genome(x: DataFrame, cds: DataFrame) -> DataFrame:
    """Genomic parts of protein ranges, one row per CDS part touched.

    ``x``: i, group_id, start, end (amino acids); ``cds``: CDS parts by
    transcript. protein_start and protein_end tell each part's amino acids. A
    range that ends behind the CDS runs on past its last part; one that starts
    behind it is an error. Transcripts without CDS have no rows."""
    ordered = in_transcription_order(cds)
    own = Window.partitionBy("group_id")
    ordered = ordered.withColumns({"total": F.sum("w").over(own), "parts": F.count(F.lit(1)).over(own)})
    rows = x.select("i", "group_id", F.col("start").alias("a"), F.col("end").alias("b")).join(ordered, "group_id")
    rows = rows.withColumns({"from": 3 * (F.col("a") - 1) + 1, "to": 3 * F.col("b")})
    behind = F.col("from") > F.col("total")
    first_nt = F.when(behind, F.raise_error(F.lit("a protein range starts behind the CDS")).cast("long")).otherwise(F.col("from"))
    is_last = F.when(F.col("to") > F.col("total"), F.col("nth") == F.col("parts")).otherwise((F.col("to") > F.col("off")) & (F.col("to") <= F.col("off") + F.col("w")))
    rows = rows.withColumns({"from": first_nt, "last": is_last, "first": (F.col("from") > F.col("off")) & (F.col("from") <= F.col("off") + F.col("w"))})
    rows = rows.where((F.col("off") + F.col("w") >= F.col("from")) & (F.col("off") < F.col("to")))
    skip, cut = F.greatest(F.lit(0), F.col("from") - F.col("off") - 1), F.when(F.col("last"), F.col("off") + F.col("w") - F.col("to")).otherwise(F.lit(0))
    minus = F.col("strand") == "-"
    start = F.when(minus, F.col("start") + cut).otherwise(F.col("start") + skip)
    end = F.when(minus, F.col("end") - skip).otherwise(F.col("end") - cut)
    ps = F.when(F.col("first"), F.col("a")).otherwise(div(F.col("off"), 3) + 1)
    pe = F.when(F.col("last"), F.col("b")).otherwise(div(F.col("off") + F.col("w") + 2, 3))
    return rows.select("i", "group_id", "nth", "seqnames", start.alias("start"), end.alias("end"), "strand", ps.alias("protein_start"), pe.alias("protein_end"))
