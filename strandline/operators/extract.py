"""Flat extractors: transcripts, exons, CDS parts, genes and what derives from them.

A planner joins only the tables that the asked columns need, since an unused
inner join would change the result. Columns of other tables come as arrays, one
per feature, complete for each feature whatever the filter was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions.ranges import dense_ids, promoter, terminator
from strandline.model import GeneModel

Filter = Mapping[str, Sequence]


def star(model: GeneModel, tables: set[str], keep_uncoded: bool = True) -> DataFrame:
    """The given tables joined around splicing, cds by a left join. Transcripts lie
    in the buckets of splicing, so merging them moves nothing, and they are not
    broadcast: their packed files look far smaller than what the driver would hold."""
    tables = set(tables)
    if len(tables) > 1 and tables & {"exon", "cds"}:
        tables.add("splicing")
    parts = [t for t in ("exon", "cds") if t in tables]
    if "splicing" not in tables and parts:
        return model[parts[0]]
    df = model.spliced(*parts, keep_uncoded=keep_uncoded) if "splicing" in tables else None
    for name in [t for t in ("transcript", "gene") if t in tables]:
        df = model[name] if df is None else df.join(model[name].hint("merge"), "_tx_id")
    return df


def _where(df: DataFrame, filters: Filter) -> DataFrame:
    for column, values in filters.items():
        df = df.where(F.col(column).isin(list(values)))
    return df


def _internal(filters: Filter | None) -> dict[str, Sequence]:
    return {schema.internal(c): v for c, v in (filters or {}).items()}


def select_rows(model: GeneModel, columns: Sequence[str], filters: Filter | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Columns by inner joins of the tables that own them; distinct rows where
    more than one table is read."""
    columns, found = [schema.internal(c) for c in columns], _internal(filters)
    tables = {schema.owner(c, schema.owner(columns[0])) for c in [*columns, *found]}
    df = _where(star(model, tables, keep_uncoded=False), found).select(*columns)
    df = df.distinct() if len(tables) > 1 else df
    return df.orderBy(*[schema.internal(c) for c in order]) if order else df


def _with_satellites(model: GeneModel, proxy: str, rows: DataFrame, columns: list[str], chosen: bool) -> DataFrame:
    """``rows`` of the proxy with one array for each column of another table;
    ``chosen`` tells that they are not all of them. Joins by the id merge: ids are
    never broadcast, as millions of them are a few MB packed. What is grouped by
    the id is dealt by it once, for the choice, the arrays and the last join."""
    key = f"_{schema.PREFIX[proxy]}_id"
    gene = [c for c in columns if schema.owner(c, proxy) == "gene"]
    bundle = [c for c in columns if c not in gene]
    ids, out = rows.select(key).hint("merge"), rows
    if bundle:
        owners = {schema.owner(c, proxy) for c in bundle}
        by = "exon_rank" if proxy == "transcript" else "_tx_id"
        found = star(model, owners | {"splicing"} | ({"transcript"} if "transcript" in owners else set())).where(F.col(key).isNotNull())
        found = found.join(ids, key, "left_semi") if chosen else found
        fields = [F.col(c).alias(c) for c in bundle]
        grouped = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("order 1"), F.col("exon_rank").alias("order 2"), *fields))).alias("list"))
        out = out.join(grouped.select(key, *[F.col(f"list.{c}").alias(c) for c in bundle]).hint("merge"), key, "left")
    if gene:
        found = model["gene"]
        if proxy != "transcript":
            found = model["splicing"].where(F.col(key).isNotNull()).select(key, "_tx_id").join(found.hint("merge"), "_tx_id")
        found = found.join(ids, key, "left_semi") if chosen else found
        grouped = found.groupBy(key, "gene_id").agg(F.min("_tx_id").alias("first")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "gene_id"))).alias("list"))
        out = out.join(grouped.select(key, F.col("list.gene_id").alias("gene_id")).hint("merge"), key, "left")
    return out


def features(model: GeneModel, proxy: str, columns: Sequence[str] | Mapping[str, str], filters: Filter | None = None, use_names: bool = False) -> DataFrame:
    """Ranges of a feature table: seqnames, start, end, strand, then ``columns``
    (a mapping names the output), ordered by id. Filters are AND-ed IN-lists on
    stored chromosome names. Features without rows in another table have an
    empty array, not null."""
    p = schema.PREFIX[proxy]
    named = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    asked = {out: schema.internal(c) for out, c in named.items()}
    found = _internal(filters)
    key, own = f"_{p}_id", set(schema.TABLES[proxy].fieldNames())
    rows = _where(model[proxy], {c: v for c, v in found.items() if c in own})
    if foreign := {c: v for c, v in found.items() if c not in own}:
        tables = {schema.owner(c, proxy) for c in foreign} | {"splicing" if proxy != "transcript" else "transcript"}
        hits = _where(star(model, tables, keep_uncoded=False), foreign).select(key)
        rows = rows.join(hits.hint("merge"), key, "left_semi")
    others = sorted({c for c in asked.values() if c not in own})
    out = rows
    if others:
        out = _with_satellites(model, proxy, rows, others, bool(found))
        kinds = {f.name: f.dataType for t in schema.OWNERS for f in schema.TABLES[t].fields}
        out = out.withColumns({c: F.coalesce(c, F.array().cast(f"array<{kinds[c].simpleString()}>")) for c in others})
    core = [F.col(f"{p}_chrom").alias("seqnames"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"), F.col(f"{p}_strand").alias("strand")]
    name = [F.coalesce(f"{p}_name", F.lit("")).alias("name")] if use_names else []
    result = out.select(*core, *name, *[F.col(c).alias(o) for o, c in asked.items()], F.col(key).alias("order id"))
    return model.attached(model.in_order(model.shown(result), "order id").drop("order id"))


def transcripts(model: GeneModel, columns=("tx_id", "tx_name"), filter: Filter | None = None, use_names: bool = False) -> DataFrame:
    return features(model, "transcript", columns, filter, use_names)


def exons(model: GeneModel, columns=("exon_id",), filter: Filter | None = None, use_names: bool = False) -> DataFrame:
    return features(model, "exon", columns, filter, use_names)


def cds(model: GeneModel, columns=("cds_id",), filter: Filter | None = None, use_names: bool = False) -> DataFrame:
    return features(model, "cds", columns, filter, use_names)


def genes(model: GeneModel, columns=("gene_id",), filter: Filter | None = None, single_strand_genes_only: bool = True) -> DataFrame:
    """One range per gene, chromosome and strand over the gene's transcripts;
    by default only genes with exactly one such range. Other columns are distinct
    sorted arrays per gene."""
    rows = model["gene"].join(model["transcript"].hint("merge"), "_tx_id")
    if filter:
        found = _internal(filter)
        own = {c: v for c, v in found.items() if c in rows.columns}
        rows = _where(rows, own)
        if foreign := {c: v for c, v in found.items() if c not in own}:
            hits = _where(star(model, {schema.owner(c) for c in foreign} | {"splicing"}, keep_uncoded=False), foreign)
            rows = rows.join(hits.hint("merge"), "_tx_id", "left_semi")
    ranges = rows.groupBy("gene_id", F.col("tx_chrom").alias("seqnames"), F.col("tx_strand").alias("strand")).agg(F.min("tx_start").alias("start"), F.max("tx_end").alias("end"))
    ranges = model.shown(ranges)
    if single_strand_genes_only:
        single = ranges.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        ranges = ranges.join(single.hint("merge"), "gene_id", "left_semi")
    others = [schema.internal(c) for c in columns if schema.internal(c) != "gene_id"]
    if others:
        owners = {schema.owner(c, "transcript") for c in others}
        full = star(model, owners | {"gene", "transcript"})
        lists = full.groupBy("gene_id").agg(*[F.array_sort(F.collect_set(c)).alias(schema.shown(c)) for c in others])
        ranges = ranges.join(lists.hint("merge"), "gene_id", "left")
    return model.attached(model.in_order(ranges.select("seqnames", "start", "end", "strand", "gene_id", *[schema.shown(c) for c in others]), "gene_id", "seqnames", "strand"))


def _around(model: GeneModel, make, upstream: int, downstream: int, use_names: bool, **how) -> DataFrame:
    rows = transcripts(model, use_names=use_names, **how)
    start, end = make(F.col("start"), F.col("end"), F.col("strand"), upstream, downstream)
    return rows.withColumns({"start": start, "end": end})


def promoters(model: GeneModel, upstream: int = 2000, downstream: int = 200, use_names: bool = True, **how) -> DataFrame:
    return _around(model, promoter, upstream, downstream, use_names, **how)


def terminators(model: GeneModel, upstream: int = 2000, downstream: int = 200, use_names: bool = True, **how) -> DataFrame:
    return _around(model, terminator, upstream, downstream, use_names, **how)


def id2name(model: GeneModel, feature_type: str = "tx") -> DataFrame:
    table = {p: t for t, p in schema.PREFIX.items()}[feature_type]
    return model[table].select(F.col(f"_{feature_type}_id").alias(f"{feature_type}_id"), f"{feature_type}_name")


def feature_table(table: DataFrame) -> DataFrame:
    """A generic feature table (chrom, chromStart, chromEnd, strand, name, ...)
    as ranges; coordinates are used as they are, '.' becomes unstranded."""
    rest = [c for c in table.columns if c not in ("chrom", "chromStart", "chromEnd", "strand")]
    strand = F.when(F.col("strand") == ".", "*").otherwise(F.col("strand"))
    return table.select(F.col("chrom").alias("seqnames"), F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"), strand.alias("strand"), *rest)


def micro_rnas(hairpins: DataFrame, coordinates: DataFrame, species: DataFrame, organism: str, model: GeneModel | None = None) -> DataFrame:
    """MicroRNA ranges of an organism from three user tables: hairpins (id,
    mirna_id, species_id), coordinates (id, chrom, start, end, strand; a minus
    strand may be told by negative positions) and species (species_id, name)."""
    mine = hairpins.join(species.where(F.col("name") == organism), "species_id").join(coordinates, "id")
    a, b = F.abs("start"), F.abs("end")
    rows = mine.select(F.col("chrom").alias("seqnames"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), "strand", "mirna_id")
    return model.shown(rows) if model is not None else rows


def unique_row_ids(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``df`` with ``id``: the number, among the distinct rows in order of first
    occurrence, of each row's distinct value. ``order`` is an integer column;
    values that begin at one place come by their own order."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first"))
    ids = dense_ids(first.where("first IS NOT NULL"), ["first", *keys], [], "first")
    a, b = df.alias("a"), ids.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], "b.id")
