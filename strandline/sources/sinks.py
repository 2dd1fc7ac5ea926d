"""BED and GFF forms of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.model import GeneModel
from strandline.operators.extract import genes


def as_bed(model: GeneModel) -> DataFrame:
    """One BED row per coding transcript: blocks are exons, the thick part is the
    range of its CDS. Starts count from 0."""
    rows = model.spliced("exon", "cds")
    t = rows.groupBy("_tx_id").agg(
        F.min("exon_start").alias("first"), F.max("exon_end").alias("last"), F.min("cds_start").alias("thick"), F.max("cds_end").alias("thick_end"),
        F.array_sort(F.collect_list(F.struct("exon_start", "exon_end"))).alias("blocks"),
    ).where("thick IS NOT NULL")
    out = t.join(model["transcript"], "_tx_id")
    sizes = F.transform("blocks", lambda x: (x["exon_end"] - x["exon_start"] + 1).cast("string"))
    starts = F.transform("blocks", lambda x: (x["exon_start"] - F.col("first")).cast("string"))
    return out.select(
        F.col("tx_chrom").alias("chrom"), (F.col("first") - 1).alias("chromStart"), F.col("last").alias("chromEnd"), F.col("tx_name").alias("name"), F.lit(0).alias("score"), F.col("tx_strand").alias("strand"),
        (F.col("thick") - 1).alias("thickStart"), F.col("thick_end").alias("thickEnd"), F.lit("0").alias("itemRgb"), F.size("blocks").alias("blockCount"), F.array_join(sizes, ",").alias("blockSizes"), F.array_join(starts, ",").alias("blockStarts"),
    )


def write_bed(model: GeneModel, path: str) -> None:
    as_bed(model).fillna({"name": "."}).write.csv(path, sep="\t", header=False)


def as_gff(model: GeneModel) -> DataFrame:
    """Gene, mRNA, exon and CDS rows with type, ID, Name and Parent (array); ids
    of genes begin with ``GeneID:``, those of transcripts with ``TxID:``."""
    none, no_parent = F.lit(None).cast("string"), F.array().cast("array<string>")
    tx_id = F.concat(F.lit("TxID:"), F.col("_tx_id").cast("string"))
    g = genes(model).select("seqnames", "start", "end", "strand", F.lit("gene").alias("type"), F.concat(F.lit("GeneID:"), "gene_id").alias("ID"), F.col("gene_id").alias("Name"), no_parent.alias("Parent"))
    parents = model["gene"].groupBy("_tx_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("GeneID:"), "gene_id"))).alias("Parent"))
    t = model["transcript"].join(parents, "_tx_id", "left").select(
        F.col("tx_chrom").alias("seqnames"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), F.col("tx_strand").alias("strand"), F.lit("mRNA").alias("type"), tx_id.alias("ID"), F.col("tx_name").alias("Name"), F.coalesce("Parent", no_parent).alias("Parent")
    )
    out = g.unionByName(t)
    for p, table, kind in (("exon", "exon", "exon"), ("cds", "cds", "CDS")):
        rows = model.spliced(table, keep_uncoded=False)
        out = out.unionByName(rows.select(F.col(f"{p}_chrom").alias("seqnames"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"), F.col(f"{p}_strand").alias("strand"), F.lit(kind).alias("type"), none.alias("ID"), F.col(f"{p}_name").alias("Name"), F.array(tx_id).alias("Parent")))
    return out


def _escaped(text: Column) -> Column:
    """The characters that have a meaning in GFF3, as percent codes."""
    for c in "%;=&,\t\n\r>":
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def write_gff3(model: GeneModel, path: str) -> None:
    rows = as_gff(model)
    part = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))
    text = F.concat_ws(";", part("ID", _escaped(F.col("ID"))), part("Name", _escaped(F.col("Name"))), part("Parent", F.array_join(F.transform("Parent", _escaped), ",")))
    strand = F.when(F.col("strand") == "*", ".").otherwise(F.col("strand"))
    phase = F.when(F.col("type") == "CDS", "0").otherwise(".")
    out = rows.select(_escaped(F.col("seqnames")), F.lit("strandline"), "type", "start", "end", F.lit("."), strand, phase, text)
    out.write.csv(path, sep="\t", header=False, quote="", escape="")
