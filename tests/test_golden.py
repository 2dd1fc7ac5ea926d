"""Golden cases of the gene-model operators, small and written out."""

import pytest
from pyspark.sql import functions as F

from strandline.model import GeneModel
from strandline.operators import coords, coverage, derived, extract, grouped, intervals, keyed, overlaps, sequences

RANGE = "seqnames string, start long, end long, strand string"


def ranges(spark, rows, head=""):
    return spark.createDataFrame(rows, (head + ", " if head else "") + RANGE)


def model(spark, tx, spl, genes=(), cds=()):
    """tx: (id, name, chrom, strand, start, end); spl: (tx, rank, exon, cds);
    exons are given by (id, chrom, strand, start, end), CDS parts likewise."""
    exons, parts = {}, {}
    rows = []
    for t, rank, e, c in spl:
        exons[e[0]] = e
        if c:
            parts[c[0]] = c
        rows.append((t, rank, e[0], c[0] if c else None, None))
    feature = lambda p: f"_{p}_id long, {p}_chrom string, {p}_strand string, {p}_start long, {p}_end long"
    named = lambda df, p: df.withColumn(f"{p}_name", F.lit(None).cast("string"))
    return GeneModel.from_tables({
        "transcript": spark.createDataFrame(tx, "_tx_id long, tx_name string, tx_chrom string, tx_strand string, tx_start long, tx_end long"),
        "exon": named(spark.createDataFrame(list(exons.values()), feature("exon")), "exon"),
        "cds": named(spark.createDataFrame(list(parts.values()), feature("cds")), "cds"),
        "splicing": spark.createDataFrame(rows, "_tx_id long, exon_rank long, _exon_id long, _cds_id long, cds_phase long"),
        "gene": spark.createDataFrame(list(genes), "gene_id string, _tx_id long"),
    })


@pytest.fixture(scope="module")
def toy(spark):
    e1, e2 = (1, "chr1", "+", 1, 100), (2, "chr2", "-", 16844685, 16844760)
    tx = [(26, "A", "chr1", "+", 1, 100), (5, "B", "chr2", "-", 16844685, 16844760), (11, "C", "chr2", "-", 16844685, 16844760)]
    return model(spark, tx, [(26, 2, e1, None), (5, 1, e2, None), (11, 1, e2, None), (26, 1, e1, None)])


def test_toy_by_exon(toy):
    rows = grouped.transcripts_by(toy, "exon").orderBy("group_id", "pos").collect()
    assert [(r["group_id"], r["tx_id"], r["exon_rank"]) for r in rows] == [(1, 26, 1), (1, 26, 2), (2, 5, 1), (2, 11, 1)]
    assert [r["group_id"] for r in grouped.nested(grouped.exons_by(toy)).orderBy("group_id").collect()] == [5, 11, 26]
    with pytest.raises(ValueError):
        grouped.transcripts_by(toy, "gene", use_names=True)


def test_distance(spark):
    e = lambda i, s, a, b: (i, "chr1", s, a, b)
    tx = [(1, "t1", "chr1", "+", 1, 999), (2, "t2", "chr1", "+", 2001, 2199), (3, "t3", "chr1", "-", 3001, 3199)]
    spl = [(1, 1, e(1, "+", 1, 999), e(10, "+", 1, 999)), (2, 1, e(2, "+", 2001, 2199), e(11, "+", 2001, 2199)), (3, 1, e(3, "-", 3001, 3199), e(14, "-", 3001, 3199))]
    m = model(spark, tx, spl, [("gene1", 1), ("gene1", 2), ("gene2", 3)])
    one = lambda strand, i, kind: overlaps.distance(m, ranges(spark, [(0, "chr1", 1050, 1050, strand)], "i int"), spark.createDataFrame([(0, i)], ["i", "id"]), kind).first()["distance"]
    assert one("-", "gene1", "gene") is None
    assert one("+", "gene1", "gene") == one("*", "gene1", "gene") == 0
    assert one("*", 3, "tx") == one("*", 14, "cds") == 1950
    assert one("+", 99, "tx") is None


def exons_of(spark, *groups):
    rows = [(g, c, a, b, s, n + 1) for g, c, s, parts in groups for n, (a, b) in enumerate(parts)]
    return spark.createDataFrame(rows, "group_id string, seqnames string, start long, end long, strand string, pos int")


PARTS = [(10, 14), (20, 24), (30, 34)]


def test_map_to_spans_introns(spark):
    x = ranges(spark, [(n, "chr1", a, b, "-") for n, (a, b) in enumerate([(11, 12), (11, 23), (21, 33), (11, 33), (40, 45)])], "i int")
    for parts in (PARTS, PARTS[::-1]):
        rows = coords.map_to_transcripts(x, exons_of(spark, ("A", "chr1", "-", parts))).collect()
        assert {r["i"]: (r["start"], r["end"]) for r in rows} == {0: (13, 14), 1: (7, 14), 2: (2, 9), 3: (2, 14)}


@pytest.mark.parametrize(("strand", "want"), [("+", {1: (2, 2, False), 2: (3, 2, True)}), ("-", {1: (4, 4, False), 2: (4, 3, True)})])
def test_map_to_intron_junctions(spark, strand, want):
    x = ranges(spark, [(n, "chr1", p, p, strand) for n, p in enumerate((1, 6, 8, 15))], "i int")
    rows = coords.map_to_transcripts(x, exons_of(spark, ("A", "chr1", strand, [(5, 6), (10, 12)])), intron_junctions=True).collect()
    assert {r["i"]: (r["start"], r["end"], r["intronic"]) for r in rows} == want


def test_map_to_origin(spark):
    x = ranges(spark, [(0, "1", 248, 248, "-")], "i int")
    e = exons_of(spark, ("A", "1", "-", [(101, 150), (201, 250)]))
    assert [(r["start"], r["strand"]) for r in coords.map_to_transcripts(x, e).collect()] == [(3, "-")]
    assert [(r["start"], r["strand"]) for r in coords.map_to_transcripts(x, e, ignore_strand=True).collect()] == [(98, "*")]
    mixed = exons_of(spark, ("A", "1", "-", [(1, 5)]), ("A", "1", "+", [(8, 9)]))
    with pytest.raises(ValueError):
        coords.check_strands(mixed)


@pytest.mark.parametrize(("strand", "start"), [("+", 106), ("-", 2036)])
def test_map_to_large(spark, strand, start):
    x = ranges(spark, [(0, "chrA", 43522349, 43522349, strand)], "i int")
    e = exons_of(spark, ("A", "chrA", strand, [(43522244, 43524145), (43528406, 43528644)]))
    assert [r["start"] for r in coords.map_to_transcripts(x, e).collect()] == [start]


def test_map_from(spark):
    head = "i int, group_id string, start long, end long, strand string"
    one = lambda a, b, s, e: [(r["start"], r["end"]) for r in coords.map_from_transcripts(spark.createDataFrame([(0, "A", a, b, s)], head), e).collect()]
    for parts in ([(1, 10), (20, 30)], [(20, 30), (1, 10)]):
        assert one(1, 5, "+", exons_of(spark, ("A", "chr1", "+", parts))) == [(1, 5)]
        assert one(1, 5, "-", exons_of(spark, ("A", "chr1", "-", parts))) == [(26, 30)]
    assert one(12, 14, "-", exons_of(spark, ("A", "chr1", "-", [(1, 10), (20, 29)]))) == [(7, 9)]
    assert one(40, 50, "+", exons_of(spark, ("A", "chr1", "+", [(1, 10)]))) == []
    with pytest.raises(ValueError):
        one(1, 2, "+", exons_of(spark, ("B", "chr1", "+", [(1, 10)])))


def test_pmap(spark):
    x = ranges(spark, [(n, "chr1", p, p, "+") for n, p in enumerate((6, 16, 1))], "i int")
    groups = [("a", [(5, 10)]), ("b", [(5, 10), (15, 20)]), ("c", [(5, 10)])]
    e = exons_of(spark, *[(g, "chr1", "+", p) for g, p in groups])
    e = e.withColumn("i", F.ascii("group_id") - 97)
    assert [(r["start"], r["end"] - r["start"] + 1) for r in coords.pmap_to_transcripts(x, e).orderBy("i").collect()] == [(2, 1), (8, 1), (0, 0)]
    y = spark.createDataFrame([(0, 40, 50)], "i int, start long, end long")
    f = exons_of(spark, ("a", "chr1", "+", [(35, 39)])).withColumn("i", F.lit(0))
    assert [tuple(r) for r in coords.pmap_from_transcripts(y, f).select("seqnames", "start", "end").collect()] == [("UNMAPPED", 0, -1)]
    z = spark.createDataFrame([(0, 1, 5), (1, 1, 5)], "i int, start long, end long")
    g = exons_of(spark, ("a", "chr1", "-", [(201, 220), (101, 120)]), ("b", "chr1", "-", [(501, 535)])).withColumn("i", F.ascii("group_id") - 97)
    got = {(r["i"], r["start"], r["end"] - r["start"] + 1) for r in coords.pmap_from_transcripts_split(z, g).collect()}
    assert got == {(0, 216, 5), (0, 101, 0), (1, 531, 5)}
    assert coords.recycled(x.limit(1), 1, 3).count() == 3
    with pytest.raises(ValueError):
        coords.recycled(x, 3, 2)


def test_extend_exons(spark):
    groups = [(f"TX{n}", "chr1", s, p) for n, (s, p) in enumerate([(s, [(10, 20), (50, 75), (100, 120)][:k]) for s in "+-" for k in (1, 2, 3)], 1)]
    want = {
        "TX1": [(10, 20)], "TX2": [(10, 22), (48, 75)], "TX3": [(10, 22), (48, 77), (98, 120)],
        "TX4": [(10, 20)], "TX5": [(8, 20), (50, 77)], "TX6": [(8, 20), (48, 77), (100, 122)],
    }
    for extent, expected in ((2, want), (0, {g: p for g, _, _, p in groups})):
        rows = derived.extend_exons_into_introns(exons_of(spark, *groups), extent).orderBy("group_id", "pos").collect()
        got = {}
        for r in rows:
            got.setdefault(r["group_id"], []).append((r["start"], r["end"]))
        assert got == expected


def test_unique_row_ids(spark):
    rows = [("chr1", "+", 5, 9), ("chr2", "-", 1, 3), ("chr1", "+", 5, 9), ("chr1", "-", 5, 9), ("chr2", "-", 1, 3)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, chrom string, strand string, start long, end long")
    got = extract.unique_row_ids(df, ["chrom", "strand", "start", "end"], "n").orderBy("n").collect()
    assert [r["id"] for r in got] == [1, 2, 1, 3, 2]


def test_protein(spark):
    cds = exons_of(spark, ("A", "chr1", "+", [(101, 110), (201, 220)]), ("B", "chr1", "-", [(101, 110), (201, 220)]))
    x = spark.createDataFrame([(0, "A", 2, 5), (1, "B", 1, 7), (2, "A", 9, 12), (3, "none", 1, 2)], "i int, group_id string, start long, end long")
    got = {(r["i"], r["start"], r["end"], r["protein_start"], r["protein_end"]) for r in coords.protein_to_genome(x, cds).collect()}
    assert got == {(0, 104, 110, 2, 4), (0, 201, 205, 4, 5), (1, 201, 220, 1, 7), (1, 110, 110, 7, 7), (2, 215, 226, 9, 12)}
    bad = spark.createDataFrame([(0, "A", 11, 12)], "i int, group_id string, start long, end long")
    with pytest.raises(Exception, match="behind the CDS"):
        coords.protein_to_genome(bad, cds).collect()


def test_locs(spark):
    e = exons_of(spark, ("A", "chr1", "-", [(100, 110), (50, 60)]))
    locs = spark.createDataFrame([(0, "A", 1), (1, "A", 12), (2, "A", 99)], "i int, group_id string, loc long")
    got = {r["loc"]: r["ref"] for r in coords.transcript_locs_to_ref_locs(locs, e, error_if_out_of_bounds=False).collect()}
    assert got == {1: 110, 12: 60, 99: None}
    with pytest.raises(Exception, match="out of bounds"):
        coords.transcript_locs_to_ref_locs(locs, e).collect()


def test_coverage(spark):
    reads = ranges(spark, [("chr1", 5, 12, "+"), ("chr1", 8, 25, "*"), ("chr1", 1, 40, "-")])
    e = exons_of(spark, ("A", "chr1", "+", [(6, 10), (21, 30)]), ("B", "chr1", "-", [(6, 10)])).drop("pos")
    got = {}
    for r in coverage.coverage_by_transcript(reads, e).orderBy("start").collect():
        got.setdefault(r["group_id"], []).append((r["start"], r["end"], r["depth"]))
    assert got == {"A": [(1, 2, 1), (3, 5, 2), (6, 10, 1), (11, 15, 0)], "B": [(1, 3, 2), (4, 5, 1)]}
    with pytest.raises(ValueError):
        coverage.coverage_by_transcript(reads, e.withColumn("strand", F.lit("*")))


def test_sequences(spark):
    genome = spark.createDataFrame([("chr1", 0, 1, "ACGTACGTAC"), ("chr1", 1, 11, "GGTTNACGTA")], "seqnames string, chunk long, start long, seq string")
    e = exons_of(spark, ("A", "chr1", "+", [(8, 12), (14, 15)]), ("B", "chr1", "-", [(14, 16), (8, 12)]))
    groups = spark.createDataFrame([("A",), ("B",), ("C",)], "group_id string")
    got = {r["group_id"]: r["seq"] for r in sequences.extract_transcript_seqs(e, genome, 10, groups).collect()}
    assert got == {"A": "TACGGTN", "B": "TNACCGTA", "C": ""}
    with pytest.raises(ValueError):
        sequences.check_exons(e.withColumn("pos", F.col("pos") * 2))


def test_overlap_kinds_match_naive(spark, sf_dir):
    from strandline.sources import star

    m = star.from_star_schema(spark, sf_dir)
    x, y = star.reads(spark, sf_dir), extract.exons(m)
    for how in ({}, {"maxgap": 300}, {"minoverlap": 30}, {"kind": "start", "maxgap": 50}, {"kind": "end", "maxgap": 50}, {"kind": "within"}, {"ignore_strand": True}):
        pairs = lambda df: sorted((r[0], r[1]) for r in df.select("l.i", "r.exon_id").collect())
        assert pairs(intervals.overlap_pairs(x, y, bin_width=700, **how)) == pairs(intervals.naive_pairs(x, y, **how))


def test_levels_and_keys(toy):
    assert toy.seqlevels() == ["chr1", "chr2"]
    renamed = toy.with_seqlevels({"chr2": "2"})
    assert {r["seqnames"] for r in extract.transcripts(renamed).collect()} == {"2"}
    assert extract.transcripts(renamed, filter={"tx_chrom": ["chr2"]}).count() == 2
    for bad in (["chr9"], ["chr1", "chr1"], {"chr1": "x", "chr2": "x"}):
        with pytest.raises(ValueError):
            toy.with_seqlevels(bad)
    assert renamed.restored().seqlevels() == ["chr1", "chr2"]
    rows = keyed.select(toy, [5, 77, 26], ["TXNAME", "EXONID"], "TXID").orderBy("i", "EXONID").collect()
    assert [(r["TXID"], r["TXNAME"], r["EXONID"]) for r in rows] == [("5", "B", 2), ("77", None, None), ("26", "A", 1)]
    assert keyed.select(toy.with_active(["chr1"]), [5], ["TXCHROM"], "TXID").first()["TXCHROM"] is None
    with pytest.raises(ValueError):
        extract.transcripts(toy, filter={"nothing": [1]})
    assert set(keyed.keytypes(toy)) <= set(keyed.columns(toy))
    assert GeneModel.from_dump(toy.dump()).equals(toy)


def test_parts_are_disjoint(spark, sf_dir):
    from strandline.sources import star

    m = star.from_star_schema(spark, sf_dir)
    parts = derived.exonic_parts(m)
    assert intervals.overlap_pairs(parts, parts).where("l.strand = r.strand AND l.start <> r.start").count() == 0
    total = parts.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0]
    assert total == intervals.reduce_ranges(extract.exons(m)).agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0]


def test_lengths_add_up(spark, sf_dir):
    from strandline.sources import star

    rows = derived.transcript_lengths(star.from_star_schema(spark, sf_dir), True, True, True).collect()
    assert all((r["cds_len"] + r["utr5_len"] + r["utr3_len"] == r["tx_len"]) if r["cds_len"] else r["utr5_len"] == r["utr3_len"] == 0 for r in rows)
