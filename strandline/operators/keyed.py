"""Keyed lookup: columns, keytypes, keys and select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import schema
from strandline.model import GeneModel

KEYTYPES = ("GENEID", "TXID", "TXNAME", "EXONID", "EXONNAME", "CDSID", "CDSNAME")
#: Order in which result columns come, by table.
_ORDER = ("cds", "exon", "gene", "splicing", "transcript")


def public(column: str) -> str:
    return column.replace("_", "").upper()


def columns(model: GeneModel) -> list[str]:
    """Upper-case names of all columns but those of metadata and chrominfo."""
    return sorted({public(c) for t in _ORDER for c in model[t].columns})


def keytypes(model: GeneModel) -> list[str]:
    return list(KEYTYPES)


def value_counts(model: GeneModel) -> DataFrame:
    """For each public column: n_values and n_keys (rows and distinct rows with a
    value there) in the table that owns it, and whether it is a key type."""
    out, homes = None, {f"_{p}_id": t for t, p in schema.PREFIX.items()}
    for t in _ORDER:
        own = [c for c in model[t].columns if schema.owner(c, homes.get(c)) == t]
        if not own:
            continue
        values = F.explode(F.array(*[F.struct(F.lit(public(c)).alias("column"), F.col(c).cast("string").alias("value")) for c in own])).alias("x")
        rows = model[t].select(values).select("x.*").groupBy("column", "value").agg(F.count("value").alias("n"))
        counts = rows.groupBy("column").agg(F.sum("n").alias("n_values"), F.count("value").alias("n_keys"))
        out = counts if out is None else out.union(counts)
    return out.select("column", "n_values", "n_keys", F.col("column").isin(*KEYTYPES).alias("keytype"))


def near(text: Column, pattern: str, edits: int) -> Column:
    """Whether some part of ``text`` is at most ``edits`` insertions, deletions or
    changes from ``pattern``. Of its edits + 1 pieces one must be there as it is,
    which rules out most texts; parts of the others are compared in a band of
    the distance only."""
    size = len(pattern)
    if not size:
        raise ValueError("an empty pattern is near everything")
    if edits >= size:
        return text.isNotNull()
    step = [size * k // (edits + 1) for k in range(edits + 2)]
    held = F.lit(False)
    for a, b in zip(step, step[1:], strict=False):
        held = held | text.contains(pattern[a:b])
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - edits) + 1, F.lit(1)))
    close = lambda s, n: F.levenshtein(F.substring(text, s, F.lit(n)), F.lit(pattern), edits) >= 0

    def any_length(s: Column) -> Column:
        found = close(s, size)
        for n in range(size - edits, size + edits + 1):
            found = found if n == size else found | close(s, n)
        return found

    return F.when(held, F.exists(starts, any_length)).otherwise(False)


def keys(model: GeneModel, keytype: str = "GENEID", pattern: str | None = None, column: str | None = None, fuzzy: bool = False, edits: int | None = None) -> DataFrame:
    """Distinct keys as text; with ``column`` only keys with a value there, or
    one that matches ``pattern``. A pattern is a regular expression; with
    ``fuzzy`` a plain text, of which some part of the value must be within
    ``edits``, by default a tenth of the pattern's length, rounded up. Without a
    pattern ``fuzzy`` is ignored."""
    key = schema.internal(keytype)
    own = schema.owner(key)
    matches = lambda value: near(value, pattern, -(-len(pattern) // 10) if edits is None else edits) if fuzzy else value.rlike(pattern)
    if column is None or public(column) == public(key):
        found = model[own].select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
        return model.in_order(found.where(matches(F.col("key"))) if pattern else found, "key")
    value = schema.internal(column)
    rows = _joined(model, key, [value]).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    if pattern:
        good = rows.select("value").distinct().where(matches(F.col("value")))
        rows = rows.join(good, "value", "left_semi")
    return model.in_order(rows.select("key").distinct(), "key")


def _joined(model: GeneModel, key: str, wanted: Sequence[str]) -> DataFrame:
    """The tables of the columns: genes by a left join (inner for gene keys),
    splicing and exons inner, CDS parts left."""
    need = {schema.owner(c) for c in [key, *wanted]}
    if len(need) == 1:
        return model[need.pop()]
    if need == {"gene", "splicing"}:
        need.add("transcript")
    df = model["transcript"]
    if "gene" in need:
        df = df.join(model["gene"], "_tx_id", "inner" if key == "gene_id" else "left")
    if need & {"splicing", "exon", "cds"}:
        df = df.join(model.spliced(*[t for t in ("exon", "cds") if t in need]), "_tx_id")
    return df


def select(model: GeneModel, keys: Sequence | DataFrame, columns: Sequence[str], keytype: str) -> DataFrame:
    """Distinct rows for the keys, in their order (``i``), with a row of nulls
    for unknown keys. The key's column comes first, then the others in schema
    order. Keys may be a DataFrame (i, key). Active chromosomes restrict rows."""
    key = schema.internal(keytype)
    wanted = {schema.internal(c) for c in columns}
    ordered = [c for t in _ORDER for c in schema.TABLES[t].fieldNames() if c in wanted and c != key and schema.owner(c, t) == t]
    ordered = list(dict.fromkeys(ordered))
    df = _joined(model, key, ordered)
    if model.active is not None:
        for c in ("tx_chrom", "exon_chrom", "cds_chrom"):
            if c in df.columns:
                df = df.where(F.col(c).isin(sorted(model.active)) | F.col(c).isNull())
    asked = keys if isinstance(keys, DataFrame) else model.spark.createDataFrame([(i, str(k)) for i, k in enumerate(keys)], "i int, key string")
    # one row per splicing may repeat a combination; keys filter before the distinct
    rows = df.select(F.col(key).cast("string").alias("key"), *ordered).join(asked.select("key").distinct(), "key", "left_semi").distinct()
    out = asked.join(rows, "key", "left")
    return out.select("i", F.col("key").alias(public(key)), *[F.col(c).alias(public(c)) for c in ordered])
