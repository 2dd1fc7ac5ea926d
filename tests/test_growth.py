"""What must not grow faster than the input: broadcasts, exchanges and buckets."""

from pyspark.sql import functions as F

from strandline.functions.ranges import dense_ids
from strandline.operators import coords, coverage, derived, extract, grouped, sequences
from strandline.plans import catalog
from strandline.sources import genome, star, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_genome_is_never_broadcast(spark, sf_dir):
    """Chunks made of twenty chromosomes look small and are as long as the genome."""
    model = star.stored_model(spark, sf_dir).unordered()
    exons = grouped.exons_by(model, "tx")
    text = plan(sequences.range_sequences(exons, star.genome(model), star.CHUNK))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_ids_are_never_broadcast(spark, sf_dir):
    """Packed files of ids are small, their rows in memory are not."""
    rows = star._rows(spark, sf_dir)
    text = plan(star._bundle(rows, star._exon(rows), star._cds(rows)).select("_tx_id", "_exon_id", "_cds_id"))
    joins = [line for line in text.splitlines() if "Join" in line and "start" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_dense_ids_deal_their_rows_once(spark):
    df = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") * 7919 % 5000).alias("p"))
    ids = dense_ids(df, ["c", "p"], ["c"], "p", block=100)
    text = plan(ids)
    assert text.count("Exchange hashpartitioning(c") - text.count("ReusedExchange") <= 2 and "REPARTITION_BY_COL" in text
    got = sorted((r["c"], r["p"], r["id"]) for r in ids.collect())
    want = sorted({(r["c"], r["p"]) for r in df.collect()})
    assert got == [(c, p, i) for i, (c, p) in enumerate(want, 1)]


def test_buckets_follow_rows(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    assert store.buckets_for(spark, 0) == cores
    assert store.buckets_for(spark, 1000 * store.BUCKET_ROWS) == 1000


def test_exons_are_dealt_to_their_buckets_once(spark, sf_dir):
    text = plan(star._rows(spark, sf_dir, 7))
    assert "hashpartitioning(_tx_id" in text and "ENSURE_REQUIREMENTS" not in text


def test_paired_ranges_stay_in_their_buckets(spark, sf_dir):
    """Places are transcripts there, so mapping back needs no exchange at any size."""
    model = star.stored_model(spark, sf_dir).unordered()
    exons = grouped.exons_by(model, "tx").withColumn("i", F.col("group_id"))
    found = coords.pmap_from_transcripts(catalog._tx_ranges(model), exons)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_coverage_reads_its_pieces_once(spark):
    """Gaps are filled in the same pass, so the overlap join is not run twice."""
    pieces = spark.range(3).select(F.lit(1).alias("group_id"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 5).alias("end"), (F.col("id") + 1).alias("depth"))
    exons = spark.range(1).select(F.lit(1).alias("group_id"), F.lit(1).cast("long").alias("start"), F.lit(30).cast("long").alias("end"))
    filled = coverage._filled(pieces, exons)
    assert sorted(map(tuple, filled.collect())) == [(1, 1, 2, 0), (1, 3, 5, 1), (1, 6, 12, 0), (1, 13, 15, 2), (1, 16, 22, 0), (1, 23, 25, 3), (1, 26, 30, 0)]
    assert filled._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_parts_are_dealt_once(spark, sf_dir):
    """Ranges go to their bins in one exchange, which grouping by segment shares;
    the others are of the next cuts, a row a bin."""
    model = star.stored_model(spark, sf_dir).unordered()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        exchanges = [x for x in plan(derived.exonic_parts(model)).splitlines() if "Exchange" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(exchanges) <= 4 and not any("seg start" in x for x in exchanges)


def test_ids_are_dealt_by_rows(spark, sf_dir):
    """Bytes of packed ids do not tell how many rows a task sorts."""
    rows = star._rows(spark, sf_dir)
    for ids in (star._exon(rows, 7), star._cds(rows, 7)):
        assert any("block" in x and ", 7)" in x and "REPARTITION_BY_NUM" in x for x in plan(ids).splitlines() if "Exchange" in x)


def test_features_never_broadcast_ids(spark, sf_dir):
    """Ten million ids of CDS parts are a few MB packed and 355 MB in the driver."""
    model = star.stored_model(spark, sf_dir).unordered()
    some = {"cds_strand": ["+"], "tx_strand": ["+"]}
    for found in (
        extract.cds(model, ("cds_id", "tx_id")), extract.cds(model, ("cds_id", "tx_id", "gene_id"), some), extract.exons(model, ("exon_id", "tx_id", "exon_rank")),
        extract.transcripts(model, ("tx_id", "exon_id", "gene_id")), extract.genes(model, ("gene_id", "tx_id")), extract.genes(model, ("gene_id",), {"exon_rank": [2]}),
    ):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    spans = [x for x in plan(star._transcript(star._orders(spark, sf_dir), star._rows(spark, sf_dir, 4))).splitlines() if "LeftOuter" in x]
    assert spans and all("SortMergeJoin" in x for x in spans)


def test_arrays_of_chosen_features_are_whole(spark, sf_dir):
    """With and without a choice a feature has the same arrays; one without rows elsewhere has empty ones."""
    model = star.stored_model(spark, sf_dir).unordered()
    rows = lambda df: {r["cds_id"]: (tuple(r["tx_id"]), tuple(r["gene_id"])) for r in df.collect()}
    whole = rows(extract.cds(model, ("cds_id", "tx_id", "gene_id")))
    part = rows(extract.cds(model, ("cds_id", "tx_id", "gene_id"), {"tx_strand": ["+"]}))
    assert 0 < len(part) < len(whole) and all(whole[k] == v for k, v in part.items())
    assert len(whole) == model["cds"].count() and any(not g for _, g in whole.values())


def test_sequences_are_dealt_by_bases(spark, sf_dir, tmp_path):
    """Packed sequences may be a hundredth of what a task sorts. Lines are cut where they are
    read, chunks written where they were put together, and joining to them moves none."""
    model = star.stored_model(spark, sf_dir).unordered()
    assert genome.parts_for(spark, 1000 * genome.PART_BASES) == 1000
    assert "REPARTITION_BY_NUM" in plan(star.genome(model))
    genome.write_fasta(star.genome(model), f"{tmp_path}/fasta", 500, 9)
    assert len(list((tmp_path / "fasta").glob("part-*"))) == 9
    chunks = genome.read_fasta(spark, f"{tmp_path}/fasta", star.CHUNK, 7)
    moved = [x for x in plan(chunks).splitlines() if "Exchange" in x and "SinglePartition" not in x and "Broadcast" not in x and "(run" not in x]
    assert len(moved) == 1 and "chunk" in moved[0] and ", 7)" in moved[0] and "REPARTITION_BY_NUM" in moved[0]
    stored = genome.store_chunks(chunks, f"{tmp_path}/chunks", 7)
    exons = grouped.exons_by(model, "tx")
    text = plan(sequences.range_sequences(exons, stored, star.CHUNK))
    moved = [x for x in text.splitlines() if "Exchange hashpartitioning(seqnames" in x]
    assert len(moved) == 1 and ", 7)" in moved[0] and "Bucketed: true" in text
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, star.genome(model).collect()))


def test_lines_are_cut_over_batches(spark, tmp_path):
    """Chunks go on from batch to batch, and sequences begin and end inside them."""
    seqs = {"a": "ACGTTGCAAC" * 7 + "ACG", "b": "T", "c": "GGCCA" * 20}
    (tmp_path / "x.fa").write_text("".join(f">{n}\n" + "".join(f"{s[i : i + 7]}\n" for i in range(0, len(s), 7)) for n, s in seqs.items()))
    want = [(n, k, 30 * k + 1, s[30 * k : 30 * k + 30]) for n, s in seqs.items() for k in range(-(-len(s) // 30))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, genome.read_fasta(spark, f"{tmp_path}/x.fa", 30, 2).collect())) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
