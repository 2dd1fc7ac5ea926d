"""Stored models, their metadata, comparison, chromosomes, keys, files and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline import schema
from strandline.model import GeneModel, genome_info
from strandline.operators import coverage, extract, grouped, keyed
from strandline.sources import genome, sinks, star, store
from strandline.sources.gff import from_gff3
from strandline.streaming import reads as streams

TX = "_tx_id long, tx_name string, tx_chrom string, tx_strand string, tx_start long, tx_end long"


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return star.stored_model(spark, sf_dir)


@pytest.fixture(scope="module")
def toy(spark):
    part = lambda p: f"_{p}_id long, {p}_name string, {p}_chrom string, {p}_strand string, {p}_start long, {p}_end long"
    return GeneModel.from_tables({
        "transcript": spark.createDataFrame([(1, "a;1", "x", "+", 1, 50), (2, "b=2,%", "x", "-", 5, 90), (3, None, "y y", "+", 1, 9)], TX),
        "exon": spark.createDataFrame([(1, "e&1", "x", "+", 1, 20), (2, None, "x", "-", 5, 90), (3, None, "y y", "+", 1, 9)], part("exon")),
        "cds": spark.createDataFrame([(1, None, "x", "+", 3, 9)], part("cds")),
        "splicing": spark.createDataFrame([(1, 1, 1, 1, None), (2, 1, 2, None, None), (3, 1, 3, None, None)], "_tx_id long, exon_rank long, _exon_id long, _cds_id long, cds_phase long"),
        "gene": spark.createDataFrame([("g;1,%a", 1), ("h+i", 2)], "gene_id string, _tx_id long"),
        "chrominfo": spark.createDataFrame([(1, "x", 1_000, False), (2, "y y", None, True)], "_chrom_id long, chrom string, length long, is_circular boolean"),
        "metadata": spark.createDataFrame([("Genome", "t1"), ("ORGANISM", "Toy"), ("Empty", None)], "name string, value string"),
    })


# -- stored models -----------------------------------------------------------------
def shuffles_below_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_stored_model_is_the_same(spark, sf_dir, stored):
    assert star.from_star_schema(spark, sf_dir).compared(stored).where("NOT same").count() == 0
    assert star.stored_model(spark, sf_dir) is stored


def test_joins_by_transcript_need_no_exchange(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = extract.star(stored, {"transcript", "splicing", "exon", "cds", "gene"})
        assert shuffles_below_joins(joined) == 0 and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert shuffles_below_joins(grouped.annotated_splicing(stored)) == 0
        assert shuffles_below_joins(grouped.exons_by(stored, "tx")) == 0
        assert shuffles_below_joins(stored["gene"].join(stored["transcript"], "_tx_id").groupBy("_tx_id").count()) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_any_model(toy):
    kept = store.stored(toy, buckets=3)
    assert kept.equals(toy) and kept.metadata() == toy.metadata()
    assert kept.spliced("cds", keep_uncoded=False).count() == 1 and kept.spliced("cds").count() == 3
    kept.tables.drop()
    assert kept["transcript"].count() == 3  # written anew


def test_changed_files_make_a_new_model(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    one = star.stored_model(spark, str(tmp_path))
    n = one["transcript"].count()
    orders.where("o_orderkey > 500").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    spark.catalog.refreshByPath(str(tmp_path))
    assert star.stored_model(spark, str(tmp_path))["transcript"].count() < n


def test_jdbc(spark, toy):
    url = "jdbc:derby:memory:strandline;create=true"
    for name, df in toy.tables.items():
        df.write.jdbc(url, name)
    assert GeneModel.from_jdbc(spark, url).equals(toy)


def test_sql(toy):
    rows = toy.sql("SELECT t.tx_name, g.gene_id FROM {transcript} t JOIN {gene} g USING (_tx_id) WHERE t._tx_id IN (SELECT id FROM {asked})", asked=toy.spark.range(2)).collect()
    assert [tuple(r) for r in rows] == [("a;1", "g;1,%a")]
    with pytest.raises(ValueError, match="no such table: nothing"):
        toy.sql("SELECT * FROM {nothing}")


# -- metadata, comparison, keys -------------------------------------------------------
def test_metadata_stays_on_results(toy, tmp_path):
    want = {"Genome": "t1", "ORGANISM": "Toy", "Empty": ""}
    assert toy.organism() == "Toy" and toy.genome() == "t1" and "# Genome: t1" in repr(toy)
    for df in (extract.transcripts(toy), extract.genes(toy), grouped.exons_by(toy), extract.promoters(toy), extract.transcripts(toy.with_seqlevels({"x": "z"}))):
        assert genome_info(df) == want
    df = extract.transcripts(toy)
    df.join(toy["gene"], df["tx_id"] == toy["gene"]["_tx_id"]).select("seqnames", "gene_id").write.parquet(f"{tmp_path}/t")
    assert genome_info(toy.spark.read.parquet(f"{tmp_path}/t")) == want
    assert genome_info(toy["gene"]) == {}


def test_comparison(spark, toy):
    t = dict(toy.tables)
    assert toy.equals(GeneModel.from_tables({**t, "transcript": t["transcript"].repartition(3)}))
    swapped = t["transcript"].withColumn("tx_name", F.when(F.col("_tx_id") == 3, F.lit("")).otherwise(F.col("tx_name")))  # null or empty
    other = GeneModel.from_tables({**t, "transcript": swapped, "gene": t["gene"].union(t["gene"])})
    got = {r["table"]: tuple(r)[1:] for r in toy.compared(other).collect()}
    assert got == {"transcripts": (3, 3, False, 1, 1), "splicings": (3, 3, True, 0, 0), "genes": (2, 4, False, 0, 2), "chrominfo": (2, 2, True, 0, 0)}


def test_key_report(spark, toy):
    assert toy.spark and schema.key_report(toy.tables).where("missing > 0 OR repeated > 0").count() == 0
    t = dict(toy.tables)
    t["exon"] = t["exon"].where("_exon_id <> 2").union(t["exon"].where("_exon_id = 1"))
    t["gene"] = t["gene"].union(spark.createDataFrame([("g", 9), ("g", 9)], "gene_id string, _tx_id long"))
    got = {r["check"]: tuple(r)[1:] for r in schema.key_report(t).where("missing > 0 OR repeated > 0").collect()}
    assert got == {"exon id": (0, 1), "splicing._exon_id": (1, 0), "gene._tx_id": (1, 0), "gene key": (0, 1)}
    assert {k for k, v in schema.key_violations(t).items() if not v.isEmpty()} == set(got)


# -- chromosomes ------------------------------------------------------------------------
def test_seqinfo_setter(toy):
    now = toy.seqinfo()
    renamed = toy.with_seqinfo(now.withColumn("seqnames", F.concat(F.lit("NEW_"), "seqnames")), [1, 2])
    assert renamed.seqlevels() == ["NEW_x", "NEW_y y"]
    assert {r["seqnames"] for r in extract.exons(renamed).collect()} == {"NEW_x", "NEW_y y"}
    foo = toy.with_seqinfo(now.withColumn("genome", F.lit("foo")))
    assert [r["genome"] for r in foo.seqinfo().collect()] == ["foo", "foo"]
    one = toy.with_seqinfo(now.where("seqnames = 'y y'"), [2])
    assert one.seqlevels() == ["y y"] and extract.exons(one).count() == 1
    for value, places, message in (
        (now.withColumn("seqlengths", F.col("seqlengths") * 5), None, "lengths"),
        (now.withColumn("isCircular", F.lit(True)), None, "circularity"),
        (now.withColumn("seqnames", F.upper("seqnames")), None, "new2old is needed"),
        (now, [1, None], "gaps"), (now, [1], "one place"), (now, [1, 1], "at most once"), (now, [1, 3], "at most once"), (now.withColumn("seqnames", F.lit("x")), [1, 2], "repeated"),
    ):
        with pytest.raises(ValueError, match=message):
            toy.with_seqinfo(value, places)
    assert toy.restored().seqlevels() == ["x", "y y"]


def test_seqinfo_merge(spark):
    kind = "seqnames string, seqlengths long, isCircular boolean, genome string, rank int"
    a = spark.createDataFrame([("1", 100, None, "g", 1), ("2", None, False, None, 2)], kind)
    b = spark.createDataFrame([("3", 7, False, None, 1), ("2", 50, None, "h", 2), ("1", 100, True, None, 3)], kind)
    rows = coverage.merged_seqinfo(a, b).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [("1", 100, True, "g", 1), ("2", 50, False, "h", 2), ("3", 7, False, None, 3)]
    with pytest.raises(Exception, match="seqlengths differ for 1"):
        coverage.merged_seqinfo(a, b.withColumn("seqlengths", F.lit(5).cast("long"))).collect()


def test_trimmed(spark):
    rows = spark.createDataFrame([(0, "1", -5, 3), (1, "1", 8, 20), (2, "1", 11, 12), (3, "2", 5, 500), (4, "3", 1, 4), (5, "1", -9, 0)], "i int, seqnames string, start long, end long")
    lengths = spark.createDataFrame([("1", 10), ("2", None)], "seqnames string, length long")
    assert sorted(tuple(r) for r in coverage.trimmed(rows, lengths).collect()) == [(0, "1", 1, 3), (1, "1", 8, 10), (3, "2", 5, 500), (4, "3", 1, 4)]


# -- keys ----------------------------------------------------------------------------------
def edits_within(text, pattern):
    """Least edits from the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row, best = new, min(best, new[-1])
    return best


@pytest.mark.parametrize(("pattern", "edits"), [("abc", 0), ("abcab", 1), ("acbb", 2), ("b", 1), ("abcabcabcabc", 3)])
def test_near(spark, pattern, edits):
    r = random.Random(4)
    texts = ["", "a", *{"".join(r.choice("abc") for _ in range(r.randint(1, 16))) for _ in range(300)}]
    got = spark.createDataFrame([(t,) for t in texts], "t string").where(keyed.near(F.col("t"), pattern, edits)).collect()
    assert {r["t"] for r in got} == {t for t in texts if edits_within(t, pattern) <= edits}


def test_fuzzy_keys(toy):
    assert [r["key"] for r in keyed.keys(toy, "TXNAME", "b=3", fuzzy=True).collect()] == ["b=2,%"]
    assert keyed.keys(toy, "TXNAME", fuzzy=True).count() == 2
    assert [r["key"] for r in keyed.keys(toy, "GENEID", "a;2", "TXNAME", fuzzy=True).collect()] == ["g;1,%a"]
    with pytest.raises(ValueError):
        keyed.near(F.lit("a"), "", 1)


# -- files ------------------------------------------------------------------------------------
@pytest.mark.parametrize("split", ["64b", "1m"])
def test_fasta(spark, tmp_path, split):
    """Lines of all lengths, names in the middle of splits, chromosomes over files."""
    r = random.Random(7)
    seqs = {name: "".join(r.choice("ACGTacgtN") for _ in range(n)) for name, n in (("one", 731), ("two", 40), ("three", 1_000), ("none", 0))}
    text = "lines before any name\n"
    for name, seq in seqs.items():
        text += f">{name} and more\r\n"
        while seq:
            n = r.choice([1, 17, 60, 61])
            text += seq[:n] + r.choice(["\n", "\r\n", "\n\n"])
            seq = seq[n:]
    cut = text.index("three") + 300
    cut = text.index("\n", cut) + 1
    folder = tmp_path / "fasta"
    folder.mkdir()
    (folder / "part-0.fa").write_bytes(text[:cut].encode())
    (folder / "part-1.fa").write_bytes(text[cut:].encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = genome.read_fasta(spark, str(folder), 100)
        rows = got.orderBy("seqnames", "chunk").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, k, 100 * k + 1, seq[100 * k : 100 * k + 100]) for name, seq in sorted(seqs.items()) for k in range(-(-len(seq) // 100))]
    assert [tuple(r) for r in rows] == want
    back = spark.createDataFrame(rows)
    genome.write_fasta(back, f"{tmp_path}/out", 50)
    assert sorted(map(tuple, genome.read_fasta(spark, f"{tmp_path}/out", 100).collect())) == want
    twice = tmp_path / "twice.fa"
    twice.write_text(">a\nACGT\n>b\nAC\n>a\nTT\n")
    with pytest.raises(Exception, match="comes twice"):
        genome.read_fasta(spark, str(twice), 100).collect()


def test_gff_escapes(spark, toy, tmp_path):
    sinks.write_gff3(toy, f"{tmp_path}/gff")
    back = from_gff3(spark, f"{tmp_path}/gff")
    assert {r["tx_name"] for r in back["transcript"].collect()} == {"a;1", "b=2,%", "TxID:3"}
    assert {r["gene_id"] for r in back["gene"].collect()} == {"g;1,%a", "h+i"}
    assert {r["tx_chrom"] for r in back["transcript"].collect()} == {"x", "y y"} and back["splicing"].count() == 3


@pytest.mark.parametrize(("cds", "message"), [([(5, 9), (12, 18)], "several CDS"), ([(5, 9), (25, 35)], "in no exon"), ([(5, 20), (30, 33)], None)])
def test_gff_strict(spark, tmp_path, cds, message):
    line = lambda kind, a, b, more: f"x\t.\t{kind}\t{a}\t{b}\t.\t+\t.\t{more}\n"
    text = line("mRNA", 1, 40, "ID=t") + "".join(line("exon", a, b, "Parent=t") for a, b in ((1, 20), (30, 40))) + "".join(line("CDS", a, b, "Parent=t") for a, b in cds)
    (tmp_path / "m.gff3").write_text("##gff-version 3\n" + text)
    assert from_gff3(spark, f"{tmp_path}/m.gff3")["splicing"].count() >= 2
    if message is None:
        assert from_gff3(spark, f"{tmp_path}/m.gff3", strict=True)["cds"].count() == 2
        return
    with pytest.raises(ValueError, match=message):
        from_gff3(spark, f"{tmp_path}/m.gff3", strict=True)


# -- streams ----------------------------------------------------------------------------------
def test_stream_resumes(spark, sf_dir, stored, tmp_path):
    """A stream that fails in the middle and goes on gives the table of one that
    does not; every window is there once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = tmp_path / "events"
    for k in range(4):
        events.where(F.pmod("event_id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(folder))
    exons = extract.exons(stored).cache()
    counts = lambda: streams.overlap_counts(streams.read_stream(spark, str(folder), "*.parquet", at_once=1), exons, late="3000 days")
    tables = {}
    for name in ("whole", "broken"):
        path, checkpoint = f"{tmp_path}/{name}/counts", f"{tmp_path}/{name}/checkpoint"
        if name == "broken":
            query = failing(counts(), path, checkpoint)
            with pytest.raises(Exception, match="on purpose"):
                query.awaitTermination()
        streams.write_counts(counts(), path, checkpoint, "update").awaitTermination()
        tables[name] = {tuple(r) for r in streams.read_counts(spark, path).collect()}
    assert tables["whole"] == tables["broken"] and len(tables["whole"]) > 5
    assert sum(r[2] for r in tables["whole"]) == sum(r["n_overlaps"] for r in streams.overlap_counts_of(spark, sf_dir, exons).collect())


def failing(counts, path, checkpoint):
    """The same sink, which writes its second batch and then fails."""

    def put(batch, number):
        rows = batch.select(F.col("w.start").alias("start"), "seqnames", "n_overlaps")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number == 1:
            raise RuntimeError("on purpose")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_stream_appends_closed_windows(spark, sf_dir, stored, tmp_path):
    exons = extract.exons(stored)
    counts = streams.overlap_counts(streams.read_stream(spark, sf_dir), exons, late="15 days")
    streams.write_counts(counts, f"{tmp_path}/counts", f"{tmp_path}/checkpoint").awaitTermination()
    closed = {(str(r["start"])[:10], r["seqnames"], r["n_overlaps"]) for r in streams.read_counts(spark, f"{tmp_path}/counts").collect()}
    every = {tuple(r) for r in streams.overlap_counts_of(spark, sf_dir, exons).collect()}
    assert closed <= every and 0 < len(closed) < len(every)
