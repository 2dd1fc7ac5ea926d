"""GeneModel: the tables of a gene model and an immutable view on its chromosomes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema


GENOME_INFO = "strandline.genomeInfo"


def genome_info(ranges: DataFrame) -> dict[str, str]:
    """The metadata of the model that ``ranges`` came from, or nothing."""
    field_ = next((f for f in ranges.schema.fields if f.name == "seqnames"), None)
    return dict(field_.metadata.get(GENOME_INFO, {})) if field_ is not None else {}


@dataclass(frozen=True)
class GeneModel:
    """Seven DataFrames and what the user made of the chromosomes.

    ``levels`` maps stored chromosome names to the names shown, in order; None
    shows all as stored. ``active`` limits keyed lookups. Results come in the
    order of their ids, which sorts them over all tasks; ``unordered`` leaves
    that out. Every change returns a new object.
    """

    tables: Mapping[str, DataFrame]
    levels: Mapping[str, str] | None = None
    active: frozenset[str] | None = None
    genome_names: Mapping[str, str] = field(default_factory=dict)
    ordered: bool = True

    # -- making --------------------------------------------------------------
    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> GeneModel:
        """From DataFrames; chrominfo and metadata are filled in where missing."""
        given = dict(tables)
        spark = next(iter(given.values())).sparkSession
        if "metadata" not in given:
            given["metadata"] = spark.createDataFrame([], schema.TABLES["metadata"])
        if "chrominfo" not in given:
            names = given["transcript"].select(F.col("tx_chrom").alias("chrom")).distinct()
            nth = F.row_number().over(_by("chrom"))
            given["chrominfo"] = names.select(nth.alias("_chrom_id"), "chrom", F.lit(None).alias("length"), F.lit(None).alias("is_circular"))
        if "tx_type" not in given["transcript"].columns:
            given["transcript"] = given["transcript"].withColumn("tx_type", F.lit(None).cast("string"))
        if "cds_phase" not in given["splicing"].columns:
            given["splicing"] = given["splicing"].withColumn("cds_phase", F.lit(None).cast("long"))
        return cls({name: schema.validate(name, given[name]) for name in schema.TABLES})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GeneModel:
        """From a folder with one Parquet table each."""
        return cls.from_tables({name: spark.read.parquet(f"{path}/{name}.parquet") for name in schema.TABLES})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, **options: str) -> GeneModel:
        """From a relational database with the seven tables, over JDBC."""
        read = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
        return cls.from_tables({name: read(name) for name in schema.TABLES})

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")

    # -- tables --------------------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def spliced(self, *features: str, keep_uncoded: bool = True) -> DataFrame:
        """Splicing rows with the columns of exon, cds or both; rows without a
        CDS part stay, with nulls, or go."""
        stored = getattr(self.tables, "bundle", None)
        if stored is not None:
            rows = stored if keep_uncoded or "cds" not in features else stored.where("_cds_id IS NOT NULL")
            return rows.select(*dict.fromkeys(c for t in ("splicing", *features) for c in schema.TABLES[t].fieldNames()))
        rows = self.tables["splicing"]
        for name in features:
            rows = rows.join(self.tables[name], f"_{name}_id", "left" if name == "cds" and keep_uncoded else "inner")
        return rows

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """A query over the model's tables, which it names in braces, and other
        frames given by name: ``SELECT * FROM {transcript} WHERE ...``. Only the
        tables named are read."""
        names = {name for _, name, _, _ in Formatter().parse(text) if name}
        if unknown := sorted(n for n in names if n not in more and n not in schema.TABLES):
            raise ValueError(f"no such table: {', '.join(unknown)}")
        return self.spark.sql(text, **{n: more[n] if n in more else self.tables[n] for n in names})

    @property
    def spark(self) -> SparkSession:
        return self.tables["transcript"].sparkSession

    def dump(self) -> dict[str, DataFrame]:
        """The logical tables: transcripts, splicings, genes, chrominfo."""
        t = self.tables
        plain = lambda df: df.select(*[F.col(c).alias(schema.shown(c)) for c in df.columns])
        splicings = self.spliced("exon", "cds")
        order = ["_tx_id", "exon_rank", "_exon_id", "exon_name", "exon_chrom", "exon_strand", "exon_start", "exon_end", "_cds_id", "cds_name", "cds_start", "cds_end", "cds_phase"]
        genes = t["gene"].select("_tx_id", "gene_id")
        return {
            "transcripts": self.in_order(plain(t["transcript"]), "tx_id"),
            "splicings": self.in_order(plain(splicings.select(*order)), "tx_id", "exon_rank"),
            "genes": self.in_order(plain(genes), "tx_id", "gene_id"),
            "chrominfo": t["chrominfo"].orderBy("_chrom_id").select("chrom", "length", "is_circular"),
        }

    @classmethod
    def from_dump(cls, dump: Mapping[str, DataFrame], metadata: DataFrame | None = None) -> GeneModel:
        """The inverse of ``dump``."""
        tx = dump["transcripts"].withColumnRenamed("tx_id", "_tx_id")
        s = dump["splicings"].withColumnsRenamed({"tx_id": "_tx_id", "exon_id": "_exon_id", "cds_id": "_cds_id"})
        place = ["exon_chrom", "exon_strand"]
        cds = s.where("_cds_id IS NOT NULL").select("_cds_id", "cds_name", F.col(place[0]).alias("cds_chrom"), F.col(place[1]).alias("cds_strand"), "cds_start", "cds_end").distinct()
        info = dump["chrominfo"]
        tables = {
            "transcript": tx,
            "exon": s.select("_exon_id", "exon_name", *place, "exon_start", "exon_end").distinct(),
            "cds": cds,
            "splicing": s.select("_tx_id", "exon_rank", "_exon_id", "_cds_id", "cds_phase"),
            "gene": dump["genes"].withColumnRenamed("tx_id", "_tx_id"),
            "chrominfo": info.select(F.row_number().over(_by("chrom")).alias("_chrom_id"), "chrom", "length", "is_circular"),
        }
        if metadata is not None:
            tables["metadata"] = metadata
        return cls.from_tables(tables)

    def equals(self, other: GeneModel) -> bool:
        """Whether two models hold the same rows, chromosome ids aside."""
        return self.compared(other).where("NOT same").isEmpty()

    def fingerprints(self) -> DataFrame:
        """Per logical table: rows, and xor and sum of their hashes. They do not
        depend on order or partitions; tables with equal ones hold the same rows
        but for a chance of about 2^-64."""
        out = None
        for name, df in self.unordered().dump().items():
            parts = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
            row = df.select(F.xxhash64(*parts).alias("h"))
            sums = row.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum")).select(F.lit(name).alias("table"), "*")
            out = sums if out is None else out.union(sums)
        return out

    def compared(self, other: GeneModel) -> DataFrame:
        """table, n_left, n_right, same, only_left, only_right (rows, as a
        multiset). Rows are compared one by one only in tables whose
        fingerprints differ: four rows that the driver looks at."""
        left, right = ({r["table"]: r for r in m.fingerprints().collect()} for m in (self, other))
        mine, theirs, out = self.unordered().dump(), other.unordered().dump(), None
        for name, a in left.items():
            b = right[name]
            same = tuple(a)[1:] == tuple(b)[1:]
            if same:
                counts = self.spark.range(1).select(F.lit(0).cast("long").alias("only_left"), F.lit(0).cast("long").alias("only_right"))
            else:
                sides = mine[name].exceptAll(theirs[name]).select(F.lit(1).alias("l"), F.lit(0).alias("r")).union(theirs[name].exceptAll(mine[name]).select(F.lit(0).alias("l"), F.lit(1).alias("r")))
                counts = sides.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("only_right"))
            row = counts.select(F.lit(name).alias("table"), F.lit(a["n"]).cast("long").alias("n_left"), F.lit(b["n"]).cast("long").alias("n_right"), F.lit(same).alias("same"), "only_left", "only_right")
            out = row if out is None else out.union(row)
        return out

    # -- metadata ------------------------------------------------------------
    def metadata(self) -> dict[str, str | None]:
        """The model's key and value pairs, read once: a small table by nature."""
        if not hasattr(self, "_metadata"):
            object.__setattr__(self, "_metadata", {r["name"]: r["value"] for r in self.tables["metadata"].collect()})
        return dict(self._metadata)

    def attached(self, ranges: DataFrame) -> DataFrame:
        """``ranges`` with the model's metadata on their column seqnames, where it
        outlives selects, joins and files; ``genome_info`` reads it."""
        found = self.metadata()
        if not found or "seqnames" not in ranges.columns:
            return ranges
        return ranges.withMetadata("seqnames", {GENOME_INFO: {k: v if v is not None else "" for k, v in found.items()}})

    def organism(self) -> str | None:
        return next((v for k, v in self.metadata().items() if k.lower() == "organism"), None)

    def genome(self) -> str | None:
        return next((v for k, v in self.metadata().items() if k.lower() == "genome"), None)

    def __repr__(self) -> str:
        lines = "".join(f"\n# {k}: {v}" for k, v in self.metadata().items())
        return f"GeneModel (schema {schema.VERSION}){lines}"

    # -- chromosomes ---------------------------------------------------------
    def seqlevels0(self) -> list[str]:
        """Stored chromosome names, in id order: a small table by nature."""
        return [r["chrom"] for r in self.tables["chrominfo"].orderBy("_chrom_id").select("chrom").collect()]

    def seqlevels(self) -> list[str]:
        return list(self.levels.values()) if self.levels is not None else self.seqlevels0()

    def seqinfo(self) -> DataFrame:
        """seqnames, seqlengths, isCircular, genome and rank of the levels shown."""
        info = self.tables["chrominfo"]
        shown = self._levels_table()
        rows = info.join(F.broadcast(shown), info["chrom"] == shown["stored"]) if shown is not None else info.withColumns({"name": F.col("chrom"), "rank": F.col("_chrom_id")})
        genome = F.lit(self.genome())
        if self.genome_names:
            pairs = [F.lit(x) for kv in self.genome_names.items() for x in kv]
            genome = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("name")), genome)
        return rows.select(F.col("name").alias("seqnames"), F.col("length").alias("seqlengths"), F.col("is_circular").alias("isCircular"), genome.alias("genome"), "rank")

    def with_seqlevels(self, levels: Iterable[str] | Mapping[str, str]) -> GeneModel:
        """Shows other levels: a list keeps a subset in that order, a mapping
        (shown name now -> new name) also renames. New levels are an error."""
        now = dict(zip(self.seqlevels(), self.levels or self.seqlevels0(), strict=True)) if self.levels is not None else {c: c for c in self.seqlevels0()}
        new = dict(levels) if isinstance(levels, Mapping) else {c: c for c in levels}
        if not isinstance(levels, Mapping) and len(new) != len(list(levels)):
            raise ValueError("levels are repeated")
        if len(set(new.values())) != len(new):
            raise ValueError("levels are repeated")
        if unknown := [c for c in new if c not in now]:
            raise ValueError(f"levels cannot be added: {', '.join(unknown)}")
        return replace(self, levels={now[old]: name for old, name in new.items()})

    def unordered(self) -> GeneModel:
        return replace(self, ordered=False)

    def in_order(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.orderBy(*columns) if self.ordered else rows

    def restored(self) -> GeneModel:
        return replace(self, levels=None, active=None, genome_names={})

    def with_seqinfo(self, value: DataFrame, new2old: Sequence[int | None] | None = None) -> GeneModel:
        """Another seqinfo (seqnames, seqlengths, isCircular, genome and rank, as
        ``seqinfo`` gives it). Names and genomes may change, and levels be dropped
        or reordered; lengths and circularity may not. ``new2old`` gives for each
        new level the place, from 1, of its old one; without it the levels must
        be the ones now. Dictionaries of chromosomes are small by nature."""
        order = lambda df: df.orderBy("rank").select("seqnames", "seqlengths", "isCircular", "genome").collect()
        new, old = order(value), order(self.seqinfo())
        if new2old is None:
            if [r["seqnames"] for r in new] != [r["seqnames"] for r in old]:
                raise ValueError("new2old is needed where the levels are not the ones now")
            new2old = range(1, len(new) + 1)
        places = list(new2old)
        if len(places) != len(new):
            raise ValueError("new2old must have one place for each new level")
        if any(p is None for p in places):
            raise ValueError("new2old cannot have gaps")
        if len(set(places)) != len(places) or any(not 1 <= p <= len(old) for p in places):
            raise ValueError("new2old must name each old level at most once")
        if len({r["seqnames"] for r in new}) != len(new):
            raise ValueError("levels are repeated")
        for r, p in zip(new, places, strict=True):
            if (r["seqlengths"], r["isCircular"]) != (old[p - 1]["seqlengths"], old[p - 1]["isCircular"]):
                raise ValueError("lengths and circularity cannot change")
        changed = self.with_seqlevels({old[p - 1]["seqnames"]: r["seqnames"] for r, p in zip(new, places, strict=True)})
        return replace(changed, genome_names={r["seqnames"]: r["genome"] for r in new if r["genome"] is not None})

    def with_genome(self, names: Mapping[str, str]) -> GeneModel:
        """Other genome names by level; lengths and circularity cannot change."""
        if unknown := set(names) - set(self.seqlevels()):
            raise ValueError(f"no such levels: {', '.join(sorted(unknown))}")
        return replace(self, genome_names=dict(names))

    def is_active(self) -> dict[str, bool]:
        return {c: self.active is None or c in self.active for c in self.seqlevels()}

    def with_active(self, levels: Iterable[str]) -> GeneModel:
        chosen = frozenset(levels)
        if unknown := chosen - set(self.seqlevels()):
            raise ValueError(f"no such levels: {', '.join(sorted(unknown))}")
        return replace(self, active=chosen)

    def _levels_table(self) -> DataFrame | None:
        if self.levels is None:
            return None
        rows = [(old, new, i) for i, (old, new) in enumerate(self.levels.items())]
        kind = T.StructType([T.StructField("stored", T.StringType()), T.StructField("name", T.StringType()), T.StructField("rank", T.IntegerType())])
        return self.spark.createDataFrame(rows, kind)

    def shown(self, ranges: DataFrame, group: str | None = None) -> DataFrame:
        """Applies the levels to extracted ranges: renames, and drops rows on
        chromosomes that are not shown; with ``group`` whole groups go if any
        member does."""
        table = self._levels_table()
        if table is None:
            return ranges
        if group is not None:
            off = ranges.join(F.broadcast(table), ranges["seqnames"] == table["stored"], "left_anti").select(group).distinct()
            ranges = ranges.join(off, group, "left_anti")
        joined = ranges.join(F.broadcast(table), ranges["seqnames"] == table["stored"])
        return joined.select(*[F.col("name").alias("seqnames") if c == "seqnames" else ranges[c] for c in ranges.columns])


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)
