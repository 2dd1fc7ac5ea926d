"""GFF3 as a source of gene models, read with Spark's own text reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.ranges import dense_ids
from strandline.model import GeneModel

_COLUMNS = T.StructType([T.StructField(c, T.StringType()) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")])
#: Feature types by role (fixed values of the sequence ontology).
TRANSCRIPT_TYPES = ("mRNA", "transcript", "ncRNA", "tRNA", "rRNA", "snRNA", "snoRNA", "lnc_RNA", "lncRNA", "miRNA", "primary_transcript", "pseudogenic_transcript")
GENE_TYPES = ("gene", "ncRNA_gene", "pseudogene")
EXON_TYPES = ("exon", "pseudogenic_exon")


def _attribute(name: str) -> Column:
    raw = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(raw != "", F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """The feature rows: seqid, type, start, end, strand, phase, feature (the ID), Parent (array), Name."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=_COLUMNS, quote="", escape="", mode="DROPMALFORMED")
    rows = rows.where("start IS NOT NULL AND attributes IS NOT NULL")
    parents = F.split(F.regexp_extract("attributes", r"(?:^|;)\s*Parent=([^;]*)", 1), ",")
    return rows.select(
        F.url_decode(F.replace("seqid", F.lit("+"), F.lit("%2B"))).alias("seqid"), "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("*").alias("strand"), F.expr("try_cast(phase AS bigint)").alias("phase"),
        _attribute("ID").alias("feature"), F.transform(F.filter(parents, lambda p: p != ""), lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))).alias("Parent"), _attribute("Name").alias("Name"),
    )


def from_gff3(spark: SparkSession, path: str, strict: bool = False) -> GeneModel:
    """A gene model from a GFF3 file.

    Transcript ids follow (chromosome, strand, start, end, name); names come from
    Name, else ID. Exons without a transcript parent are dropped; a transcript
    without exons gets its CDS parts, or itself, as exons. Ranks follow the
    position, from the right on the minus strand. A CDS part belongs to the exon
    of its transcript that holds it. One that no exon holds is left out, and an
    exon that holds several has a splicing row for each; with ``strict`` both are
    errors.
    """
    rows = read_gff3(spark, path)
    place = [F.col("seqid").alias("chrom"), "strand", "start", "end"]
    found = rows.where(F.col("type").isin(*TRANSCRIPT_TYPES) & F.col("feature").isNotNull()).select("feature", F.coalesce("Name", "feature").alias("tx_name"), F.col("type").alias("tx_type"), *place, "Parent")
    order = ["chrom", "strand", "start", "end", "tx_name", "feature"]
    tx = found.join(dense_ids(found, order, ["chrom", "strand"], "start").withColumnRenamed("id", "_tx_id"), order)
    parts = rows.select("*", F.explode("Parent").alias("of")).join(tx.select(F.col("feature").alias("of"), "_tx_id"), "of")
    exons = parts.where(F.col("type").isin(*EXON_TYPES)).select("_tx_id", F.coalesce("Name", "feature").alias("exon_name"), *place)
    cds = parts.where("type = 'CDS'").select("_tx_id", F.coalesce("Name", "feature").alias("cds_name"), *place, "phase")
    bare = tx.join(exons, "_tx_id", "left_anti")
    from_cds = cds.join(bare.select("_tx_id"), "_tx_id", "left_semi").select("_tx_id", F.lit(None).cast("string").alias("exon_name"), "chrom", "strand", "start", "end")
    alone = bare.join(cds, "_tx_id", "left_anti").select("_tx_id", F.lit(None).cast("string").alias("exon_name"), "chrom", "strand", "start", "end")
    exons = exons.union(from_cds).union(alone)
    up = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    ranked = exons.withColumn("exon_rank", F.row_number().over(Window.partitionBy("_tx_id").orderBy(up, "end")))
    keys = ["chrom", "strand", "start", "end"]
    named = lambda df, name: df.groupBy(*keys).agg(F.min(name).alias(name)).join(dense_ids(df, keys, ["chrom", "strand"], "start"), keys)
    exon_table, cds_table = named(exons, "exon_name"), named(cds, "cds_name")
    x = ranked.join(exon_table.select(*keys, F.col("id").alias("_exon_id")), keys).alias("x")
    c = cds.join(cds_table.select(*keys, F.col("id").alias("_cds_id")), keys).alias("c")
    held = (F.col("x._tx_id") == F.col("c._tx_id")) & (F.col("c.start") >= F.col("x.start")) & (F.col("c.end") <= F.col("x.end"))
    splicing = x.join(c, held, "left").select("x._tx_id", "x.exon_rank", "x._exon_id", "c._cds_id", F.col("c.phase").alias("cds_phase"))
    if strict:
        if not c.join(x, held, "left_anti").isEmpty():
            raise ValueError("some CDS parts lie in no exon of their transcript")
        if not splicing.groupBy("_tx_id", "exon_rank").count().where("count > 1").isEmpty():
            raise ValueError("some exons hold several CDS parts of a transcript")
    genes = rows.where(F.col("type").isin(*GENE_TYPES)).select(F.col("feature").alias("gene"), F.coalesce("Name", "feature").alias("gene_id"))
    gene = tx.select("_tx_id", F.explode("Parent").alias("gene")).join(genes, "gene").select("gene_id", "_tx_id").distinct()
    feature = lambda df, p: df.select(F.col("id").alias(f"_{p}_id"), f"{p}_name", F.col("chrom").alias(f"{p}_chrom"), F.col("strand").alias(f"{p}_strand"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    tx_table = tx.select("_tx_id", "tx_name", "tx_type", F.col("chrom").alias("tx_chrom"), F.col("strand").alias("tx_strand"), F.col("start").alias("tx_start"), F.col("end").alias("tx_end"))
    return GeneModel.from_tables({"transcript": tx_table, "exon": feature(exon_table, "exon"), "cds": feature(cds_table, "cds"), "splicing": splicing, "gene": gene})
