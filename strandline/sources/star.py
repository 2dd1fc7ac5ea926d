"""A gene model, reads and a genome derived from the star-schema tables.

Orders become transcripts, line items exons and events reads, by integer rules
that any SQL engine repeats. Five neighbouring orders share a gene's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions.ranges import dense_ids, div
from strandline.model import GeneModel
from strandline.sources import genome as fasta
from strandline.sources import store

CHROMS = 20
#: Positions of a chunk, and chunks that are made in one go.
CHUNK, BLOCK = 2_000, 1 << 12
METADATA = [("Genome", "made-up"), ("Organism", "Ordo lineatus"), ("Source", "orders and lineitem"), ("Schema version", schema.VERSION)]


def _placed(keys: DataFrame) -> DataFrame:
    """Adds g, chrom, strand and base to rows with _tx_id."""
    rows = keys.withColumn("g", div(F.col("_tx_id"), 5))
    return rows.withColumns({
        "chrom": F.concat(F.lit("chr"), (F.col("g") % CHROMS + 1).cast("string")),
        "strand": F.when(F.col("g") % 2 == 0, "+").otherwise("-"),
        "base": div(F.col("g"), CHROMS) * 8000 + 1,
    })


def _by_transcript(df: DataFrame, buckets: int | None) -> DataFrame:
    return df if buckets is None else df.repartition(buckets, "_tx_id")


def _rows(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Exons with their transcript: line items grouped first, as order and line
    number are not unique. With ``buckets`` dealt into them at once, so that the
    grouping, the join, the ranks and the writing need no exchange of their own."""
    orders = _by_transcript(_orders(spark, sf_dir), buckets)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = items.select(F.col("l_orderkey").cast("long").alias("_tx_id"), F.col("l_linenumber").cast("long").alias("slot"), "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    items = _by_transcript(items, buckets)
    slots = items.groupBy("_tx_id", "slot").agg(F.max("l_suppkey").alias("a"), F.max("q").alias("q")).join(orders, "_tx_id", "left_semi")
    rows = _placed(slots)
    start = F.col("base") + F.col("slot") * 1000 + F.col("a") % 3 * 10
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + 99 + F.col("q") % 3 * 50)
    coding = F.col("_tx_id") % 4 != 0
    cs, ce = F.greatest("start", F.col("base") + 2025), F.least("end", F.col("base") + 5120)
    rows = rows.withColumns({"cds_start": F.when(coding & (cs <= ce), cs), "cds_end": F.when(coding & (cs <= ce), ce)})
    by = Window.partitionBy("_tx_id").orderBy(F.when(F.col("strand") == "+", F.col("slot")).otherwise(-F.col("slot")))
    return rows.withColumn("exon_rank", F.row_number().over(by).cast("long")).select("_tx_id", "exon_rank", "chrom", "strand", "start", "end", "cds_start", "cds_end")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("_tx_id"))


_CDS = ["chrom", "strand", "cds_start", "cds_end"]


def _none() -> Column:
    return F.lit(None).cast("string")


def _exon(rows: DataFrame, parts: int | None = None) -> DataFrame:
    keys = ["chrom", "strand", "start", "end"]
    ids = dense_ids(rows.select(*keys), keys, ["chrom", "strand"], "start", parts=parts)
    return ids.select(F.col("id").alias("_exon_id"), _none().alias("exon_name"), F.col("chrom").alias("exon_chrom"), F.col("strand").alias("exon_strand"), F.col("start").alias("exon_start"), F.col("end").alias("exon_end"))


def _cds(rows: DataFrame, parts: int | None = None) -> DataFrame:
    ids = dense_ids(rows.where("cds_start IS NOT NULL").select(*_CDS), _CDS, ["chrom", "strand"], "cds_start", parts=parts)
    return ids.select(F.col("id").alias("_cds_id"), _none().alias("cds_name"), F.col("chrom").alias("cds_chrom"), F.col("strand").alias("cds_strand"), "cds_start", "cds_end")


def _bundle(rows: DataFrame, exon: DataFrame, cds: DataFrame) -> DataFrame:
    """Rows with the ids that their places got: all of splicing, exon and cds.
    Neither table of ids is broadcast, however small its packed file is, and rows
    without a CDS part, which would meet in a task a chromosome, join none."""
    exon_ids = exon.select("_exon_id", F.col("exon_chrom").alias("chrom"), F.col("exon_strand").alias("strand"), F.col("exon_start").alias("start"), F.col("exon_end").alias("end"))
    cds_ids = cds.select("_cds_id", F.col("cds_chrom").alias("chrom"), F.col("cds_strand").alias("strand"), "cds_start", "cds_end")
    coded, plain = rows.where("cds_start IS NOT NULL"), rows.where("cds_start IS NULL").withColumn("_cds_id", F.lit(None).cast("long"))
    both = coded.join(cds_ids.hint("merge"), _CDS, "left").unionByName(plain)
    all_ = both.join(exon_ids.hint("merge"), ["chrom", "strand", "start", "end"])
    coded = lambda c: F.when(F.col("_cds_id").isNotNull(), F.col(c))
    return all_.select(
        "_tx_id", "exon_rank", "_exon_id", "_cds_id", F.lit(None).cast("long").alias("cds_phase"),
        _none().alias("exon_name"), F.col("chrom").alias("exon_chrom"), F.col("strand").alias("exon_strand"), F.col("start").alias("exon_start"), F.col("end").alias("exon_end"),
        _none().alias("cds_name"), coded("chrom").alias("cds_chrom"), coded("strand").alias("cds_strand"), "cds_start", "cds_end",
    )


def _transcript(orders: DataFrame, rows: DataFrame) -> DataFrame:
    spans = rows.groupBy("_tx_id").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    tx = _placed(orders).join(spans.hint("merge"), "_tx_id", "left")
    return tx.select(
        "_tx_id", F.when(F.col("_tx_id") % 13 != 0, F.concat(F.lit("T"), F.col("_tx_id").cast("string"))).alias("tx_name"), _none().alias("tx_type"),
        F.col("chrom").alias("tx_chrom"), F.col("strand").alias("tx_strand"), F.coalesce("s", "base").alias("tx_start"), F.coalesce("e", F.col("base") + 99).alias("tx_end"),
    )


def _gene(orders: DataFrame) -> DataFrame:
    g = div(F.col("_tx_id"), 5)
    ids = F.when(g % 11 != 0, F.array_compact(F.array(g, F.when(F.col("_tx_id") % 37 == 0, g + 1))))
    return orders.select("_tx_id", F.explode(ids).alias("g")).select(F.concat(F.lit("G"), F.col("g").cast("string")).alias("gene_id"), "_tx_id")


def _chrominfo(transcript: DataFrame) -> DataFrame:
    longest = transcript.agg((F.max("tx_end") + 5000).alias("length"))
    chroms = transcript.sparkSession.range(1, CHROMS + 1).select(F.col("id").alias("_chrom_id"), F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"))
    return chroms.join(F.broadcast(longest), F.lit(True)).select("_chrom_id", "chrom", "length", F.lit(False).alias("is_circular"))


def from_star_schema(spark: SparkSession, sf_dir: str) -> GeneModel:
    """The model of ``orders`` and ``lineitem``, computed whenever it is read."""
    rows, orders = _rows(spark, sf_dir), _orders(spark, sf_dir)
    exon, cds, transcript = _exon(rows), _cds(rows), _transcript(orders, rows)
    splicing = _bundle(rows, exon, cds).select(*schema.TABLES["splicing"].fieldNames())
    return GeneModel.from_tables({"transcript": transcript, "exon": exon, "cds": cds, "splicing": splicing, "gene": _gene(orders), "chrominfo": _chrominfo(transcript), "metadata": spark.createDataFrame(METADATA, schema.TABLES["metadata"])})


_STORED: dict[tuple, GeneModel] = {}


def stored_model(spark: SparkSession, sf_dir: str) -> GeneModel:
    """The same model written once per session and state of the files: each table
    when a query first needs it, those with transcripts in buckets of them."""
    size, state = store.fingerprint(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"])
    key = (spark.sparkContext.applicationId, spark, sf_dir, size, state)
    if key not in _STORED:
        n = store.buckets_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
        valid = lambda name, df: schema.validate(name, df)
        make = {
            "rows": lambda t: _rows(spark, sf_dir, n),
            "exon": lambda t: valid("exon", _exon(t["rows"], n)),
            "cds": lambda t: valid("cds", _cds(t["rows"], n)),
            "bundle": lambda t: _bundle(t["rows"], t["exon"], t["cds"]),
            "splicing": lambda t: t["bundle"].select(*schema.TABLES["splicing"].fieldNames()),
            "transcript": lambda t: valid("transcript", _transcript(_by_transcript(_orders(spark, sf_dir), n), t["rows"])),
            "gene": lambda t: valid("gene", _gene(_orders(spark, sf_dir))),
            "chrominfo": lambda t: valid("chrominfo", _chrominfo(t["transcript"])),
            "metadata": lambda t: spark.createDataFrame(METADATA, schema.TABLES["metadata"]),
        }
        kept = ("rows", "exon", "cds", "bundle", "transcript", "gene", "chrominfo")
        _STORED[key] = GeneModel(store.StoredTables(spark, make, kept, n, ("rows", "transcript")))
    return _STORED[key]


def reads(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ranges with ``i`` (the event) from ``events``; also for a stream of them."""
    e = events if events is not None else spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.col("event_id") * 7919) % 1_200_000 + 1
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("i"), F.concat(F.lit("chr"), (F.col("user_id") % CHROMS + 1).cast("string")).alias("seqnames"), start.alias("start"), (start + 49 + F.col("event_id") % 100).alias("end"), strand.alias("strand"), *keep)


def _base(x: int, k: int) -> str:
    return "ACGT"[(7 * x + x // 3 + k) % 4]


def _bases(k: Column, first: Column, last: Column) -> Column:
    """Bases ``first`` to ``last`` of chromosome ``k``: they repeat every twelve."""
    period = F.element_at(F.array(*[F.lit("".join(_base(x, n) for x in range(12))) for n in range(4)]), (k % 4 + 1).cast("int"))
    size = (last - first + 1).cast("int")
    return F.substring(F.repeat(period, (F.floor(size / 12) + 2).cast("int")), (first % 12 + 1).cast("int"), size)


def genome_parts(model: GeneModel) -> int:
    """Parts that the genome's bases ask for; lengths of chromosomes tell them."""
    return fasta.parts_for(model.spark, model["chrominfo"].agg(F.sum("length")).first()[0] or 0)


def genome(model: GeneModel, wanted: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Chunks (seqnames, chunk, start, seq) of a made-up genome. With ``wanted``
    (ranges) only the chunks they touch are made. Chromosomes are cut in blocks
    of chunks first, which are dealt, so that many tasks make them."""
    info = model["chrominfo"].select(F.col("chrom").alias("seqnames"), F.col("_chrom_id").alias("k"), "length")
    last = div(F.col("length") - 1, chunk)
    blocks = info.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), div(last, BLOCK)))).repartition(genome_parts(model), "seqnames", "block")
    rows = blocks.withColumn("chunk", F.explode(F.sequence(F.col("block") * BLOCK, F.least(last, (F.col("block") + 1) * BLOCK - 1))))
    if wanted is not None:
        touched = wanted.where("end >= start").select("seqnames", F.explode(F.sequence(div(F.col("start") - 1, chunk), div(F.col("end") - 1, chunk))).alias("chunk")).distinct()
        rows = rows.join(touched.hint("merge"), ["seqnames", "chunk"], "left_semi")
    first = F.col("chunk") * chunk + 1
    return rows.select("seqnames", "chunk", first.alias("start"), _bases(F.col("k"), first, F.least(F.col("length"), first + chunk - 1)).alias("seq"))
