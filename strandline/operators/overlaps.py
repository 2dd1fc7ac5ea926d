"""Overlap queries on a model, id mapping and distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions.ranges import gap, strands_agree
from strandline.model import GeneModel
from strandline.operators import extract
from strandline.operators.intervals import overlap_pairs, subset_by_overlaps

_EXTRACT = {"tx": extract.transcripts, "exon": extract.exons, "cds": extract.cds}


def _by_overlaps(model: GeneModel, p: str, ranges: DataFrame, columns, how: dict) -> DataFrame:
    columns = list(columns)
    key = f"{p}_id"
    rows = _EXTRACT[p](model, columns if key in columns else [*columns, key])
    out = subset_by_overlaps(rows, ranges, key, **how)
    return out if key in columns else out.drop(key)


def transcripts_by_overlaps(model: GeneModel, ranges: DataFrame, columns=("tx_id", "tx_name"), **how) -> DataFrame:
    """``how``: kind (any, start, end, within, equal), maxgap, minoverlap."""
    return _by_overlaps(model, "tx", ranges, columns, how)


def exons_by_overlaps(model: GeneModel, ranges: DataFrame, columns=("exon_id",), **how) -> DataFrame:
    return _by_overlaps(model, "exon", ranges, columns, how)


def cds_by_overlaps(model: GeneModel, ranges: DataFrame, columns=("cds_id",), **how) -> DataFrame:
    return _by_overlaps(model, "cds", ranges, columns, how)


def map_ranges_to_ids(model: GeneModel, ranges: DataFrame, feature: str = "tx", columns: Sequence[str] | None = None, **how) -> DataFrame:
    """For every named range (column ``name``) the ids, or ``columns``, of the
    features it overlaps: long form, one row per hit."""
    if feature == "gene":
        rows, keep = extract.genes(model, columns or ("gene_id",)), list(columns or ("gene_id",))
    else:
        keep = list(columns or (f"{feature}_id",))
        rows = _EXTRACT[feature](model, keep)
    pairs = overlap_pairs(ranges.select("name", "seqnames", "start", "end", "strand"), rows, **how)
    return pairs.select(F.col("l.name").alias("name"), *[F.col(f"r.{c}").alias(c) for c in keep])


def map_ids_to_ranges(model: GeneModel, keys: Mapping[str, Sequence], feature: str = "tx", columns: Sequence[str] | None = None) -> DataFrame:
    """Ranges for a list of keys, parallel to it: ``i`` is the key's place,
    repeated keys repeat their ranges, unknown keys have a row of nulls."""
    (column, values), = keys.items()
    stored = schema.internal(column)
    shown = schema.shown(stored)
    kind = next(f.dataType for t in schema.OWNERS for f in schema.TABLES[t].fields if f.name == stored)
    asked = model.spark.createDataFrame(list(enumerate(values)), f"i int, key {kind.simpleString()}")
    wanted = list(dict.fromkeys([shown, *(columns or ())]))
    if feature == "gene":
        rows = extract.genes(model, tuple(dict.fromkeys(["gene_id", *wanted])), {column: list(values)})
    else:
        rows = _EXTRACT[feature](model, wanted, {column: list(values)})
    listed = dict(rows.dtypes)[shown].startswith("array")
    rows = rows.withColumn("key", F.explode(F.array_distinct(shown)) if listed else F.col(shown))
    rows = rows if columns and shown in columns else rows.drop(shown)
    return model.in_order(asked.join(rows, "key", "left"), "i", "start", "end")


def distance(model: GeneModel, x: DataFrame, ids: DataFrame, feature: str = "tx", ignore_strand: bool = False) -> DataFrame:
    """Distance of the i-th range of ``x`` (i, seqnames, start, end, strand) to
    the i-th id of ``ids`` (i, id): 0 if they touch or overlap; null if the id is
    unknown or has several ranges, on another chromosome, or the strands clash."""
    if feature == "gene":
        rows = extract.genes(model).withColumnRenamed("gene_id", "id")
    else:
        rows = _EXTRACT[feature](model, (f"{feature}_id",)).withColumnRenamed(f"{feature}_id", "id")
    y = rows.select("id", *[F.col(c).alias(f"y_{c}") for c in ("seqnames", "start", "end", "strand")])
    both = x.join(ids, "i").join(y, "id", "left")
    near = F.greatest(F.lit(0).cast("long"), gap(F.col("start"), F.col("end"), F.col("y_start"), F.col("y_end")))
    fits = (F.col("seqnames") == F.col("y_seqnames")) & strands_agree(F.col("strand"), F.col("y_strand"), ignore_strand)
    return both.select("i", F.when(fits, near).alias("distance"))
