"""Grouped extractors in long form: one row per member, with its group's id."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.model import GeneModel

_ID = {"tx": "_tx_id", "exon": "_exon_id", "cds": "_cds_id"}
_TABLE = {"tx": "transcript", "exon": "exon", "cds": "cds"}


def _range_columns(p: str) -> list:
    return [F.col(f"{p}_chrom").alias("seqnames"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"), F.col(f"{p}_strand").alias("strand")]


def _named(model: GeneModel, rows: DataFrame, by: str, use_names: bool) -> DataFrame:
    """Group names from the group's table; illegal for genes, which have none."""
    if not use_names:
        return rows.withColumn("group_name", F.col("group_id").cast("string"))
    if by == "gene":
        raise ValueError("use_names cannot be used when grouping by gene")
    names = model[_TABLE[by]].select(F.col(_ID[by]).alias("group_id"), F.coalesce(f"{by}_name", F.lit("")).alias("group_name"))
    odd = names.groupBy("group_name").count().where("count > 1 OR group_name = ''")
    if not odd.isEmpty():
        warnings.warn("some group names are missing or duplicated", stacklevel=3)
    return rows.join(names, "group_id")


def _by_gene(model: GeneModel, p: str) -> DataFrame:
    """Distinct features of each gene; a feature of several transcripts once."""
    if p == "tx":
        links = model["gene"].select("gene_id", "_tx_id")
    else:
        links = model["gene"].join(model["splicing"], "_tx_id").where(F.col(_ID[p]).isNotNull()).select("gene_id", _ID[p]).distinct()
    rows = links.join(model[_TABLE[p]], _ID[p])
    return rows.select(F.col("gene_id").alias("group_id"), *_range_columns(p), F.col(_ID[p]).alias(f"{p}_id"), f"{p}_name", F.col(_ID[p]).alias("pos"))


def _grouped(model: GeneModel, rows: DataFrame, by: str, use_names: bool) -> DataFrame:
    return model.attached(model.shown(_named(model, rows, by, use_names), "group_id"))


def transcripts_by(model: GeneModel, by: str = "gene", use_names: bool = False) -> DataFrame:
    """By gene, exon or cds; the latter two carry exon_rank, ordered by
    (tx_id, exon_rank); splicings without a cds have no group."""
    if by == "gene":
        return _grouped(model, _by_gene(model, "tx"), by, use_names)
    key = _ID[by]
    rows = model["splicing"].where(F.col(key).isNotNull()).join(model["transcript"], "_tx_id")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_tx_id", "exon_rank")).cast("long")
    rows = rows.select(F.col(key).alias("group_id"), *_range_columns("tx"), F.col("_tx_id").alias("tx_id"), "tx_name", "exon_rank", pos.alias("pos"))
    return _grouped(model, rows, by, use_names)


def _by_tx(model: GeneModel, p: str) -> DataFrame:
    rows = model.spliced(_TABLE[p], keep_uncoded=False)
    return rows.select(F.col("_tx_id").alias("group_id"), *_range_columns(p), F.col(_ID[p]).alias(f"{p}_id"), f"{p}_name", "exon_rank", F.col("exon_rank").alias("pos"))


def exons_by(model: GeneModel, by: str = "tx", use_names: bool = False) -> DataFrame:
    return _grouped(model, _by_tx(model, "exon") if by == "tx" else _by_gene(model, "exon"), by, use_names)


def cds_by(model: GeneModel, by: str = "tx", use_names: bool = False) -> DataFrame:
    return _grouped(model, _by_tx(model, "cds") if by == "tx" else _by_gene(model, "cds"), by, use_names)


def group_names(model: GeneModel) -> DataFrame:
    """All transcripts as groups, for results that show empty ones."""
    return model["transcript"].select(F.col("_tx_id").alias("group_id"))


def introns_by_transcript(model: GeneModel, use_names: bool = False) -> DataFrame:
    """What a transcript's range has outside its exons, numbered by position.
    Transcripts without introns or without exons have no rows."""
    tx = model["transcript"].join(model["splicing"], "_tx_id", "left_semi")
    exons = _by_tx(model, "exon").select("group_id", "start", "end")
    edge = tx.select(F.col("_tx_id").alias("group_id"), F.col("tx_end").alias("stop"), F.col("tx_start").alias("first"), F.col("tx_chrom").alias("seqnames"), F.col("tx_strand").alias("strand"))
    # one more, empty, exon behind the transcript's end closes its last gap
    closing = edge.select("group_id", (F.col("stop") + 1).alias("start"), F.col("stop").alias("end"))
    order = Window.partitionBy("group_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = exons.union(closing).withColumn("reached", reached).join(edge, "group_id")
    gaps = rows.select("group_id", "seqnames", F.greatest(F.coalesce(F.col("reached") + 1, F.col("first")), F.col("first")).alias("start"), F.least(F.col("start") - 1, F.col("stop")).alias("end"), "strand")
    gaps = gaps.where("end >= start").withColumn("pos", F.row_number().over(Window.partitionBy("group_id").orderBy("start")).cast("long"))
    return _grouped(model, gaps, "tx", use_names)


def annotated_splicing(model: GeneModel) -> DataFrame:
    """Splicing with exon and cds ranges and, in coding transcripts, the first
    and last rank that has a cds part (``fc``, ``lc``)."""
    rows = model.spliced("exon", "cds")
    own = Window.partitionBy("_tx_id")
    coded = F.when(F.col("_cds_id").isNotNull(), F.col("exon_rank"))
    return rows.withColumns({"fc": F.min(coded).over(own), "lc": F.max(coded).over(own)})


def utr_rows(model: GeneModel, side: int) -> DataFrame:
    """The untranslated part of every exon on one side (5 or 3) of the CDS; on an
    unstranded exon nothing is trimmed."""
    s = annotated_splicing(model).where("fc IS NOT NULL")
    edge, outside = ("fc", F.col("exon_rank") <= F.col("fc")) if side == 5 else ("lc", F.col("exon_rank") >= F.col("lc"))
    at = F.col("exon_rank") == F.col(edge)
    right_cut, left_cut = ("+", "-") if side == 5 else ("-", "+")
    end = F.when(at & (F.col("exon_strand") == right_cut), F.col("cds_start") - 1).otherwise(F.col("exon_end"))
    start = F.when(at & (F.col("exon_strand") == left_cut), F.col("cds_end") + 1).otherwise(F.col("exon_start"))
    rows = s.where(outside).withColumns({"start": start, "end": end}).where("end >= start")
    return rows.select(F.col("_tx_id").alias("group_id"), F.col("exon_chrom").alias("seqnames"), "start", "end", F.col("exon_strand").alias("strand"), F.col("_exon_id").alias("exon_id"), "exon_name", "exon_rank", F.col("exon_rank").alias("pos"))


def five_utrs_by_transcript(model: GeneModel, use_names: bool = False) -> DataFrame:
    return _grouped(model, utr_rows(model, 5), "tx", use_names)


def three_utrs_by_transcript(model: GeneModel, use_names: bool = False) -> DataFrame:
    return _grouped(model, utr_rows(model, 3), "tx", use_names)


def nested(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The nested form: one row per group with its members as an array in order;
    with ``groups`` empty groups appear too."""
    rest = [c for c in rows.columns if c not in ("group_id", "group_name", "pos")]
    lists = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("members"))
    if groups is None:
        return lists
    kind = lists.schema["members"].dataType.simpleString()
    return groups.join(lists, "group_id", "left").select("group_id", F.coalesce("members", F.array().cast(kind)).alias("members"))
