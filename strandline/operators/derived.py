"""Tables derived per transcript: lengths, tidy forms, disjoint parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.model import GeneModel
from strandline.operators.grouped import annotated_splicing, exons_by, introns_by_transcript
from strandline.operators.intervals import covered_segments


def scalar_genes(model: GeneModel, multiple: str = "raise") -> DataFrame:
    """(_tx_id, gene_id) with one gene each. A transcript of several genes is an
    error, or with ``multiple="join"`` gets their ids comma-joined."""
    genes = model["gene"].groupBy("_tx_id").agg(F.array_sort(F.collect_set("gene_id")).alias("ids"))
    if multiple == "raise" and not genes.where(F.size("ids") > 1).isEmpty():
        raise ValueError('some transcripts have several genes; multiple="join" joins their ids')
    return genes.select("_tx_id", F.array_join("ids", ",").alias("gene_id"))


def transcript_lengths(model: GeneModel, with_cds_len: bool = False, with_utr5_len: bool = False, with_utr3_len: bool = False, multiple: str = "join") -> DataFrame:
    """tx_id, tx_name, gene_id, nexon, tx_len and the lengths asked for, from one
    grouping of the splicing rows; 0, not null, where there is nothing."""
    s = annotated_splicing(model)
    w = F.col("exon_end") - F.col("exon_start") + 1
    coded = F.col("cds_end") - F.col("cds_start") + 1
    plus, minus = F.col("exon_strand") == "+", F.col("exon_strand") == "-"
    right, left = F.col("exon_end") - F.col("cds_end"), F.col("cds_start") - F.col("exon_start")

    def utr(edge: str, beyond: Column, on_plus: Column, on_minus: Column) -> Column:
        part = F.when(F.col("exon_rank") == F.col(edge), F.when(plus, on_plus).when(minus, on_minus).otherwise(w))
        return F.sum(F.when(beyond, w).otherwise(F.coalesce(part, F.lit(0))))

    sums = s.groupBy("_tx_id").agg(
        F.count(F.lit(1)).alias("nexon"), F.sum(w).alias("tx_len"), F.sum(coded).alias("cds_len"),
        utr("fc", F.col("exon_rank") < F.col("fc"), left, right).alias("utr5_len"), utr("lc", F.col("exon_rank") > F.col("lc"), right, left).alias("utr3_len"),
    )
    wanted = ["nexon", "tx_len", *[c for c, on in (("cds_len", with_cds_len), ("utr5_len", with_utr5_len), ("utr3_len", with_utr3_len)) if on]]
    rows = model["transcript"].select("_tx_id", "tx_name").join(scalar_genes(model, multiple), "_tx_id", "left").join(sums, "_tx_id", "left")
    return model.in_order(rows.select(F.col("_tx_id").alias("tx_id"), "tx_name", "gene_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in wanted]), "tx_id")


def transcript_widths(starts: Column, ends: Column) -> Column:
    """Sum of exon widths from arrays, or comma-separated strings, of borders."""
    return F.aggregate(F.zip_with(_longs(starts), _longs(ends), lambda s, e: e - s + 1), F.lit(0).cast("long"), lambda a, b: a + b)


def _longs(values: Column) -> Column:
    text = F.split(F.regexp_replace(values.cast("string"), r"[\[\]\s]", ""), ",")
    return F.transform(F.filter(text, lambda x: x != ""), lambda x: x.cast("long"))


def tidy_transcripts(model: GeneModel, drop_geneless: bool = False, multiple: str = "join") -> DataFrame:
    tx = model["transcript"].join(scalar_genes(model, multiple), "_tx_id", "inner" if drop_geneless else "left")
    rows = tx.select(F.col("tx_chrom").alias("seqnames"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), F.col("tx_strand").alias("strand"), F.col("_tx_id").alias("tx_id"), "tx_name", "gene_id")
    return model.in_order(model.shown(rows), *(["gene_id", "tx_id"] if drop_geneless else ["tx_id"]))


def _tidy(model: GeneModel, members: DataFrame, columns: list[str], drop_geneless: bool, multiple: str) -> DataFrame:
    tx = model["transcript"].select(F.col("_tx_id").alias("tx_id"), "tx_name")
    genes = scalar_genes(model, multiple).withColumnRenamed("_tx_id", "tx_id")
    rows = members.withColumnRenamed("group_id", "tx_id").join(tx, "tx_id").join(genes, "tx_id", "inner" if drop_geneless else "left")
    last = [c for c in ("exon_rank", "pos") if c in members.columns][:1]
    return model.in_order(rows.select("seqnames", "start", "end", "strand", "tx_id", "tx_name", "gene_id", *columns), *(["gene_id"] if drop_geneless else []), "tx_id", *(last if last[0] in columns else ["start"]))


def tidy_exons(model: GeneModel, drop_geneless: bool = False, multiple: str = "join", strict: bool = False) -> DataFrame:
    """One row per exon of a transcript. Transcripts without exons are skipped,
    or with ``strict`` an error."""
    if strict and not model["transcript"].join(model["splicing"], "_tx_id", "left_anti").isEmpty():
        raise ValueError("some transcripts have no exons")
    return _tidy(model, exons_by(model, "tx"), ["exon_id", "exon_name", "exon_rank"], drop_geneless, multiple)


def tidy_introns(model: GeneModel, drop_geneless: bool = False, multiple: str = "join") -> DataFrame:
    return _tidy(model, introns_by_transcript(model), [], drop_geneless, multiple)


def _parts(rows: DataFrame, lists: list[str], single_gene: bool, number: str) -> DataFrame:
    """Disjoint parts of ``rows`` with the distinct values of ``lists``."""
    pairs = covered_segments(rows)
    # by bin as well, though a segment has one: its rows lie together by that
    own = ["seqnames", F.col("seg start").alias("start"), F.col("seg end").alias("end"), "strand"]
    parts = pairs.groupBy(*own, "seg bin").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in lists]).drop("seg bin")
    if not single_gene:
        return parts
    parts = parts.where(F.size("gene_id") == 1).withColumn("gene_id", F.get("gene_id", 0))
    return parts.withColumn(number, F.row_number().over(Window.partitionBy("gene_id").orderBy("seqnames", "strand", "start")).cast("long"))


def _with_all_genes(model: GeneModel, members: DataFrame, single_gene: bool) -> DataFrame:
    tx = model["transcript"].select(F.col("_tx_id").alias("group_id"), "tx_name")
    genes = model["gene"].withColumnRenamed("_tx_id", "group_id")
    return members.join(tx, "group_id").join(genes, "group_id", "inner" if single_gene else "left").withColumnRenamed("group_id", "tx_id")


def exonic_parts(model: GeneModel, linked_to_single_gene_only: bool = False) -> DataFrame:
    """Disjoint parts of all exons, per chromosome and strand, with arrays of the
    transcripts, genes and exons behind each. ``linked_to_single_gene_only``
    starts from gene-linked exons, keeps parts of one gene and numbers them."""
    rows = _with_all_genes(model, exons_by(model, "tx"), linked_to_single_gene_only)
    return _parts(rows, ["tx_id", "tx_name", "gene_id", "exon_id", "exon_name", "exon_rank"], linked_to_single_gene_only, "exonic_part")


def intronic_parts(model: GeneModel, linked_to_single_gene_only: bool = False) -> DataFrame:
    rows = _with_all_genes(model, introns_by_transcript(model), linked_to_single_gene_only)
    return _parts(rows, ["tx_id", "tx_name", "gene_id"], linked_to_single_gene_only, "intronic_part")


def extend_exons_into_introns(exons: DataFrame, extent: int = 2) -> DataFrame:
    """Grouped exons (group_id, pos, ranges) grown by ``extent`` where an intron
    follows or goes before them; single exons stay."""
    own = Window.partitionBy("group_id")
    rank, n = F.row_number().over(own.orderBy("pos")), F.count(F.lit(1)).over(own)
    before, after = F.when(rank > 1, extent).otherwise(0), F.when(rank < n, extent).otherwise(0)
    minus = F.col("strand") == "-"
    grown = {"start": F.col("start") - F.when(minus, after).otherwise(before), "end": F.col("end") + F.when(minus, before).otherwise(after)}
    return exons.withColumns(grown)


def rank_in_group(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))
