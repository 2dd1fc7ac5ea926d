"""The gene-model tables: fixed columns, keys, and which table owns a column.

Coordinates are 1-based and closed; a range of width zero has end = start - 1.
Strands are ``+``, ``-`` and ``*`` (unstranded). Ids and coordinates are longs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.2"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _feature(p: str, typed: bool = False) -> T.StructType:
    kind = [(f"{p}_type", _S, True)] if typed else []
    return _struct((f"_{p}_id", _L, False), (f"{p}_name", _S, True), *kind, (f"{p}_chrom", _S, False), (f"{p}_strand", _S, False), (f"{p}_start", _L, False), (f"{p}_end", _L, False))


TABLES: dict[str, T.StructType] = {
    "chrominfo": _struct(("_chrom_id", _L, False), ("chrom", _S, False), ("length", _L, True), ("is_circular", _B, True)),
    "transcript": _feature("tx", typed=True),
    "exon": _feature("exon"),
    "cds": _feature("cds"),
    "splicing": _struct(("_tx_id", _L, False), ("exon_rank", _L, False), ("_exon_id", _L, False), ("_cds_id", _L, True), ("cds_phase", _L, True)),
    "gene": _struct(("gene_id", _S, False), ("_tx_id", _L, False)),
    "metadata": _struct(("name", _S, False), ("value", _S, True)),
}
PREFIX = {"transcript": "tx", "exon": "exon", "cds": "cds"}
#: Order in which a column's owner is looked up, and in which tables are joined.
OWNERS = ("transcript", "splicing", "exon", "cds", "gene", "chrominfo")


def owner(column: str, prefer: str | None = None) -> str:
    """The table of a column; ``prefer`` wins where it has the column."""
    for name in ([prefer] if prefer else []) + list(OWNERS):
        if column in TABLES[name].fieldNames():
            return name
    raise ValueError(f"no such column: {column}")


def internal(column: str) -> str:
    """The stored name of a column given by its plain or upper-case alias."""
    low = column.lower()
    known = {f for t in OWNERS for f in TABLES[t].fieldNames()}
    spelled = {f.replace("_", ""): f for f in known}
    for candidate in (column, low, f"_{low}", spelled.get(low.replace("_", ""), "")):
        if candidate in known:
            return candidate
    raise ValueError(f"no such column: {column}")


def shown(column: str) -> str:
    """The name users see: without the leading underscore of internal ids."""
    return column.lstrip("_")


def validate(name: str, df: DataFrame) -> DataFrame:
    """``df`` as table ``name``: checked for its columns, cast, in order."""
    want = TABLES[name]
    missing = [f for f in want.fieldNames() if f not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])


def key_violations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that break a key: anti joins for references, counts for unique keys."""
    t, out = tables, {}
    for child, column, parent in (("splicing", "_tx_id", "transcript"), ("splicing", "_exon_id", "exon"), ("gene", "_tx_id", "transcript")):
        out[f"{child}.{column}"] = t[child].join(t[parent], column, "left_anti")
    out["splicing._cds_id"] = t["splicing"].where("_cds_id IS NOT NULL").join(t["cds"], "_cds_id", "left_anti")
    for name, p in PREFIX.items():
        out[f"{name}.{p}_chrom"] = t[name].join(t["chrominfo"], t[name][f"{p}_chrom"] == t["chrominfo"]["chrom"], "left_anti")
        out[f"{name} id"] = t[name].groupBy(f"_{p}_id").count().where("count > 1")
    out["splicing key"] = t["splicing"].groupBy("_tx_id", "exon_rank").count().where("count > 1")
    out["gene key"] = t["gene"].groupBy("gene_id", "_tx_id").count().where("count > 1")
    return out


def key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """check, missing, repeated: for every reference how many distinct keys have
    no row in the table they refer to, for every unique key how many come more
    than once. All checks are one grouping of (check, key), with rows counted
    before they are shuffled."""
    t, rows = tables, None

    def add(check: str, df: DataFrame, columns: list[str], parent: bool) -> None:
        nonlocal rows
        part = df.select(F.lit(check).alias("check"), F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}).alias("key"), F.lit(int(parent)).alias("parent"), F.lit(int(not parent)).alias("child"))
        rows = part if rows is None else rows.union(part)

    for parent, p in PREFIX.items():
        add(f"{parent} id", t[parent], [f"_{p}_id"], True)
        add(f"{parent}.{p}_chrom", t[parent], [f"{p}_chrom"], False)
        add(f"{parent}.{p}_chrom", t["chrominfo"], ["chrom"], True)
        add(f"splicing._{p}_id", t["splicing"].where(F.col(f"_{p}_id").isNotNull()), [f"_{p}_id"], False)
        add(f"splicing._{p}_id", t[parent], [f"_{p}_id"], True)
    add("gene._tx_id", t["gene"], ["_tx_id"], False)
    add("gene._tx_id", t["transcript"], ["_tx_id"], True)
    add("splicing key", t["splicing"], ["_tx_id", "exon_rank"], True)
    add("gene key", t["gene"], ["gene_id", "_tx_id"], True)
    keys = rows.groupBy("check", "key").agg(F.sum("parent").alias("parent"), F.sum("child").alias("child"))
    unique = F.col("check").isin(*[f"{parent} id" for parent in PREFIX], "splicing key", "gene key")
    return keys.groupBy("check").agg(F.count_if((F.col("child") > 0) & (F.col("parent") == 0)).alias("missing"), F.count_if(unique & (F.col("parent") > 1)).alias("repeated"))
