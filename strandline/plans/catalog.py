"""Every operator as a query over the derived model, with its SQL twin.

Queries return scalars: arrays are joined in order, so that engines compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import model, schema
from strandline.model import GeneModel
from strandline.operators import coords, coverage, derived, extract, grouped, intervals, keyed, overlaps, sequences
from strandline.plans.model_sql import BASE, RC, sql
from strandline.sources import genome, sinks, star, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(twin: str | None = None, more: str = "", name: str | None = None):
    """Registers a function of (model, spark, sf_dir) and its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(star.stored_model(spark, sf_dir).unordered(), spark, sf_dir)
        if twin is not None:
            SQL[key] = sql(twin, more)
        return f

    return add


def _text(array: str | Column, missing: str = "NA") -> Column:
    return F.array_join((F.col(array) if isinstance(array, str) else array).cast("array<string>"), ",", missing)


_TX = 'chrom AS seqnames, ts AS start, te AS "end", strand'
_RANGE = 'chrom AS seqnames, s AS start, e AS "end", strand'
_MEMBER = ["group_id", "seqnames", "start", "end", "strand"]


# -- flat extractors -----------------------------------------------------------
@_query(f"SELECT {_TX}, tx AS tx_id, tx_name FROM tr")
def transcripts(m, s, d):
    return extract.transcripts(m)


@_query(f"""SELECT {_TX}, tx AS tx_id, coalesce(tx_name, '') AS name, coalesce((SELECT string_agg(gene_id, ',' ORDER BY gene_id) FROM ge WHERE ge.tx = tr.tx), '') AS gene_id
FROM tr WHERE chrom IN ('chr1', 'chr3') AND strand = '+' AND tx IN (SELECT tx FROM sp WHERE rk = 3 AND cds_id IS NOT NULL)""")
def transcripts_filtered(m, s, d):
    rows = extract.transcripts(m, ("tx_id", "gene_id"), {"tx_chrom": ["chr1", "chr3"], "tx_strand": ["+"], "exon_rank": [3], "cds_strand": ["+"]}, use_names=True)
    return rows.withColumn("gene_id", _text(F.array_sort("gene_id")))


@_query("""SELECT tr.tx AS tx_id, coalesce(string_agg(CAST(exon_id AS VARCHAR), ',' ORDER BY rk), '') AS exon_id, coalesce(string_agg(CAST(rk AS VARCHAR), ',' ORDER BY rk), '') AS exon_rank,
coalesce(string_agg(coalesce(CAST(cds_id AS VARCHAR), 'NA'), ',' ORDER BY rk) FILTER (exon_id IS NOT NULL), '') AS cds_id FROM tr LEFT JOIN sp ON tr.tx = sp.tx GROUP BY tr.tx""")
def transcripts_with_exon_lists(m, s, d):
    rows = extract.transcripts(m, ("tx_id", "exon_id", "exon_rank", "cds_id"))
    return rows.select("tx_id", *[_text(c).alias(c) for c in ("exon_id", "exon_rank", "cds_id")])


@_query(f"""SELECT {_RANGE}, exon_id, string_agg(CAST(tx AS VARCHAR), ',' ORDER BY tx) AS tx_id, string_agg(CAST(rk AS VARCHAR), ',' ORDER BY tx) AS exon_rank
FROM sp GROUP BY chrom, s, e, strand, exon_id""")
def exons(m, s, d):
    rows = extract.exons(m, ("exon_id", "tx_id", "exon_rank"))
    return rows.withColumns({"tx_id": _text("tx_id"), "exon_rank": _text("exon_rank")})


@_query(f"SELECT DISTINCT {_RANGE}, exon_id, '' AS name FROM sp WHERE tx IN (SELECT tx FROM tr WHERE tx_name IN ('T5', 'T12', 'T100', 'T101'))")
def exons_by_tx_name(m, s, d):
    return extract.exons(m, ("exon_id",), {"TXNAME": ["T5", "T12", "T100", "T101"]}, use_names=True)


@_query("""SELECT chrom AS seqnames, cs AS start, ce AS "end", strand, cds_id, string_agg(CAST(tx AS VARCHAR), ',' ORDER BY tx) AS tx_id FROM sp WHERE cds_id IS NOT NULL GROUP BY chrom, cs, ce, strand, cds_id""")
def cds(m, s, d):
    return extract.cds(m, ("cds_id", "tx_id")).withColumn("tx_id", _text("tx_id"))


_GENES = "SELECT gene_id, chrom AS seqnames, strand, min(ts) AS start, max(te) AS \"end\" FROM ge JOIN tr USING (tx) GROUP BY gene_id, chrom, strand"


@_query(f"SELECT * FROM ({_GENES}) WHERE gene_id IN (SELECT gene_id FROM ({_GENES}) GROUP BY 1 HAVING count(*) = 1)")
def genes(m, s, d):
    return extract.genes(m)


@_query(_GENES)
def genes_all(m, s, d):
    return extract.genes(m, single_strand_genes_only=False)


@_query(f"SELECT g.*, t.tx_id FROM ({_GENES}) g JOIN (SELECT gene_id, string_agg(CAST(tx AS VARCHAR), ',' ORDER BY tx) AS tx_id FROM (SELECT DISTINCT gene_id, tx FROM ge) GROUP BY 1) t USING (gene_id)")
def genes_with_transcripts(m, s, d):
    return extract.genes(m, ("gene_id", "tx_id"), single_strand_genes_only=False).withColumn("tx_id", _text("tx_id"))


@_query("""SELECT chrom AS seqnames, CASE WHEN strand = '-' THEN te - 199 ELSE ts - 2000 END AS start, CASE WHEN strand = '-' THEN te + 2000 ELSE ts + 199 END AS "end", strand, coalesce(tx_name, '') AS name, tx AS tx_id, tx_name FROM tr""")
def promoters(m, s, d):
    return extract.promoters(m)


@_query("""SELECT chrom AS seqnames, CASE WHEN strand = '-' THEN ts - 199 ELSE te - 2000 END AS start, CASE WHEN strand = '-' THEN ts + 2000 ELSE te + 199 END AS "end", strand, coalesce(tx_name, '') AS name, tx AS tx_id, tx_name FROM tr""")
def terminators(m, s, d):
    return extract.terminators(m)


@_query("SELECT tx AS tx_id, tx_name FROM tr")
def id2name_tx(m, s, d):
    return extract.id2name(m, "tx")


@_query("SELECT exon_id, min(s) AS start FROM sp WHERE strand = '+' AND rk = 2 GROUP BY exon_id")
def select_rows(m, s, d):
    return extract.select_rows(m, ["exon_id", "exon_start"], {"exon_strand": ["+"], "exon_rank": [2]}).select(F.col("_exon_id").alias("exon_id"), F.col("exon_start").alias("start"))


@_query("SELECT DISTINCT tx AS tx_id, exon_id, coalesce(cds_id, -1) AS cds_id FROM sp")
def splicing_bundle(m, s, d):
    rows = extract.star(m, {"splicing", "exon", "cds"})
    return rows.select(F.col("_tx_id").alias("tx_id"), F.col("_exon_id").alias("exon_id"), F.coalesce("_cds_id", F.lit(-1)).alias("cds_id")).distinct()


@_query("SELECT row_number() OVER (ORDER BY k) AS id, chrom, n FROM (SELECT chrom, min(tx) AS k, count(*) AS n FROM tr GROUP BY chrom)")
def unique_row_ids(m, s, d):
    rows = m["transcript"].select("tx_chrom", F.col("_tx_id").alias("order"))
    return extract.unique_row_ids(rows, ["tx_chrom"], "order").groupBy("id", F.col("tx_chrom").alias("chrom")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT 'chr' || (p_size % 20 + 1) AS seqnames, p_partkey * 10 AS start, p_partkey * 10 + p_size AS \"end\", CASE p_size % 3 WHEN 0 THEN '*' WHEN 1 THEN '+' ELSE '-' END AS strand, p_name AS name FROM part")
def features(m, s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    strand = F.element_at(F.array(F.lit("."), F.lit("+"), F.lit("-")), (F.col("p_size") % 3 + 1).cast("int"))
    table = p.select(F.concat(F.lit("chr"), (F.col("p_size") % 20 + 1).cast("string")).alias("chrom"), (F.col("p_partkey") * 10).alias("chromStart"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("chromEnd"), strand.alias("strand"), F.col("p_name").alias("name"))
    return extract.feature_table(table)


@_query("SELECT 'chr' || (s_nationkey % 20 + 1) AS seqnames, s_suppkey * 100 AS start, s_suppkey * 100 + 21 AS \"end\", '-' AS strand, s_name AS mirna_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 7")
def micro_rnas(m, s, d):
    sup, nat = s.read.parquet(f"{d}/supplier.parquet"), s.read.parquet(f"{d}/nation.parquet")
    hair = sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("mirna_id"), F.col("s_nationkey").alias("species_id"))
    where = sup.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("chr"), (F.col("s_nationkey") % 20 + 1).cast("string")).alias("chrom"), (-F.col("s_suppkey") * 100 - 21).alias("start"), (-F.col("s_suppkey") * 100).alias("end"), F.lit("-").alias("strand"))
    species = nat.select(F.col("n_nationkey").alias("species_id"), F.when(F.col("n_nationkey") == 7, "Mus").otherwise("other").alias("name"))
    return extract.micro_rnas(hair, where, species, "Mus")


# -- grouped extractors ----------------------------------------------------------
def _group(name: str, rows, twin: str, extra: tuple[str, ...]):
    @_query(twin, name=name)
    def f(m, s, d):
        return rows(m).select(*_MEMBER, *extra)


_G = "{g} AS group_id, " + _RANGE
_group("transcripts_by_gene", lambda m: grouped.transcripts_by(m, "gene"), f'SELECT gene_id AS group_id, {_TX}, tx AS tx_id FROM ge JOIN tr USING (tx)', ("tx_id",))
_group("transcripts_by_exon", lambda m: grouped.transcripts_by(m, "exon"), 'SELECT exon_id AS group_id, tr.chrom AS seqnames, ts AS start, te AS "end", tr.strand, tx AS tx_id, rk AS exon_rank FROM sp JOIN tr USING (tx)', ("tx_id", "exon_rank"))
_group("transcripts_by_cds", lambda m: grouped.transcripts_by(m, "cds"), 'SELECT cds_id AS group_id, tr.chrom AS seqnames, ts AS start, te AS "end", tr.strand, tx AS tx_id, rk AS exon_rank FROM sp JOIN tr USING (tx) WHERE cds_id IS NOT NULL', ("tx_id", "exon_rank"))
_group("exons_by_tx", lambda m: grouped.exons_by(m, "tx"), f"SELECT {_G.format(g='tx')}, exon_id, rk AS exon_rank FROM sp", ("exon_id", "exon_rank"))
_group("exons_by_gene", lambda m: grouped.exons_by(m, "gene"), f"SELECT DISTINCT {_G.format(g='gene_id')}, exon_id FROM ge JOIN sp USING (tx)", ("exon_id",))
_group("cds_by_tx", lambda m: grouped.cds_by(m, "tx"), 'SELECT tx AS group_id, chrom AS seqnames, cs AS start, ce AS "end", strand, cds_id, rk AS exon_rank FROM sp WHERE cds_id IS NOT NULL', ("cds_id", "exon_rank"))
_group("cds_by_gene", lambda m: grouped.cds_by(m, "gene"), 'SELECT DISTINCT gene_id AS group_id, chrom AS seqnames, cs AS start, ce AS "end", strand, cds_id FROM ge JOIN sp USING (tx) WHERE cds_id IS NOT NULL', ("cds_id",))
_group("introns_by_tx", grouped.introns_by_transcript, f"SELECT {_G.format(g='tx')}, row_number() OVER (PARTITION BY tx ORDER BY s) AS pos FROM intron", ("pos",))
_group("five_utrs", grouped.five_utrs_by_transcript, f"SELECT {_G.format(g='tx')}, exon_id, rk AS exon_rank FROM utr5", ("exon_id", "exon_rank"))
_group("three_utrs", grouped.three_utrs_by_transcript, f"SELECT {_G.format(g='tx')}, exon_id, rk AS exon_rank FROM utr3", ("exon_id", "exon_rank"))


@_query("SELECT tr.tx AS group_id, coalesce(string_agg(s || '-' || e, ',' ORDER BY s), '') AS members FROM tr LEFT JOIN intron ON tr.tx = intron.tx GROUP BY tr.tx")
def introns_nested(m, s, d):
    rows = grouped.nested(grouped.introns_by_transcript(m), grouped.group_names(m))
    return rows.select("group_id", F.array_join(F.transform("members", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("members"))


# -- overlaps ------------------------------------------------------------------
_HIT = "r.chrom = x.chrom AND (r.strand = x.strand OR r.strand = '*')"
_ANY = f"{_HIT} AND r.s <= x.e AND r.e >= x.s"


def _tx_by_overlaps(name: str, cond: str, **how):
    @_query(f"SELECT {_TX}, tx AS tx_id, tx_name FROM tr WHERE tx IN (SELECT x.tx FROM (SELECT tx, chrom, strand, ts AS s, te AS e FROM tr) x JOIN reads r ON {_HIT} AND {cond})", name=name)
    def f(m, s, d):
        return overlaps.transcripts_by_overlaps(m, star.reads(s, d), **how)


_tx_by_overlaps("transcripts_by_overlaps", "r.s <= x.e AND r.e >= x.s")
_tx_by_overlaps("overlaps_maxgap", "greatest(r.s, x.s) - least(r.e, x.e) - 1 <= 500", maxgap=500)
_tx_by_overlaps("overlaps_minoverlap", "r.s <= x.e AND r.e >= x.s AND least(r.e, x.e) - greatest(r.s, x.s) + 1 >= 60", minoverlap=60)
_tx_by_overlaps("overlaps_start", "abs(r.s - x.s) <= 40", kind="start", maxgap=40)
_tx_by_overlaps("overlaps_end", "abs(r.e - x.e) <= 40", kind="end", maxgap=40)


@_query(f"SELECT {_RANGE}, exon_id FROM exon WHERE exon_id IN (SELECT x.exon_id FROM exon x JOIN reads r ON {_ANY})")
def exons_by_overlaps(m, s, d):
    return overlaps.exons_by_overlaps(m, star.reads(s, d))


@_query(f"""SELECT chrom AS seqnames, cs AS start, ce AS "end", strand, cds_id FROM cdsd WHERE cds_id IN (SELECT x.cds_id FROM (SELECT cds_id, chrom, strand, cs AS s, ce AS e FROM cdsd) x JOIN reads r ON {_ANY})""")
def cds_by_overlaps(m, s, d):
    return overlaps.cds_by_overlaps(m, star.reads(s, d))


@_query(f"SELECT r.i AS i, x.exon_id FROM reads r JOIN exon x ON r.chrom = x.chrom AND (r.strand = x.strand OR r.strand = '*') AND r.s >= x.s AND r.e <= x.e")
def overlaps_within(m, s, d):
    x = extract.exons(m)
    return intervals.overlap_pairs(star.reads(s, d), x, kind="within").select("l.i", "r.exon_id")


@_query("SELECT tx, exon_id, i FROM (SELECT x.tx, x.exon_id, r.i FROM sp x JOIN reads r ON " + _ANY + ")")
def read_exon_pairs(m, s, d):
    x = grouped.exons_by(m, "tx").select("group_id", "exon_id", *intervals.CORE)
    return intervals.overlap_pairs(star.reads(s, d), x).select(F.col("r.group_id").alias("tx"), "r.exon_id", "l.i")


@_query(f"SELECT 'read' || r.i AS name, x.tx AS tx_id FROM reads r JOIN (SELECT tx, chrom, strand, ts AS s, te AS e FROM tr) x ON {_ANY}")
def map_ranges_to_ids(m, s, d):
    named = star.reads(s, d).withColumn("name", F.concat(F.lit("read"), F.col("i").cast("string")))
    return overlaps.map_ranges_to_ids(m, named, "tx")


@_query(f"SELECT 'read' || r.i AS name, x.exon_id FROM reads r JOIN exon x ON {_ANY}")
def map_ranges_to_exon_ids(m, s, d):
    named = star.reads(s, d).withColumn("name", F.concat(F.lit("read"), F.col("i").cast("string")))
    return overlaps.map_ranges_to_ids(m, named, "exon")


@_query(f"""SELECT 'read' || r.i AS name, x.gene_id FROM reads r JOIN (SELECT gene_id, min(seqnames) AS chrom, min(strand) AS strand, min(start) AS s, max("end") AS e FROM ({_GENES}) GROUP BY gene_id HAVING count(*) = 1) x ON {_ANY}""")
def map_ranges_to_gene_ids(m, s, d):
    named = star.reads(s, d).withColumn("name", F.concat(F.lit("read"), F.col("i").cast("string")))
    return overlaps.map_ranges_to_ids(m, named, "gene")


@_query("SELECT exon_id, cds_id FROM (SELECT DISTINCT exon_id, chrom, strand, s, e FROM sp) x JOIN cdsd c ON c.chrom = x.chrom AND c.strand = x.strand AND c.cs = x.s AND c.ce = x.e")
def overlaps_equal(m, s, d):
    return intervals.overlap_pairs(extract.exons(m), extract.cds(m), kind="equal").select("l.exon_id", "r.cds_id")


_KEYS = ["G7", "G2", "no such gene", "G7", "G18"]


@_query(f"""SELECT CAST(k.i AS INTEGER) AS i, k.gene AS gene_id, tx AS tx_id, chrom AS seqnames, ts AS start, te AS "end", strand
FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(_KEYS))}) k(i, gene) LEFT JOIN (ge JOIN tr USING (tx)) x ON x.gene_id = k.gene""")
def map_ids_to_ranges(m, s, d):
    rows = overlaps.map_ids_to_ranges(m, {"gene_id": _KEYS}, "tx", ("tx_id",))
    return rows.select("i", F.col("key").alias("gene_id"), "tx_id", "seqnames", "start", "end", "strand")


@_query(f"""SELECT k.i, k.gene AS gene_id, x.exon_id, x.chrom AS seqnames, x.s AS start, x.e AS "end" FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(_KEYS))}) k(i, gene)
LEFT JOIN (SELECT DISTINCT gene_id, exon_id, chrom, s, e FROM ge JOIN sp USING (tx)) x ON x.gene_id = k.gene""")
def map_ids_to_exon_ranges(m, s, d):
    rows = overlaps.map_ids_to_ranges(m, {"gene_id": _KEYS}, "exon", ("exon_id",))
    return rows.select("i", F.col("key").alias("gene_id"), "exon_id", "seqnames", "start", "end")


_DIST = "CASE WHEN r.chrom = y.chrom AND (r.strand = y.strand OR r.strand = '*') THEN greatest(0, greatest(r.s, y.s) - least(r.e, y.e) - 1) END"


@_query(f"SELECT r.i AS i, CAST({_DIST} AS BIGINT) AS distance FROM reads r LEFT JOIN (SELECT tx, chrom, strand, ts AS s, te AS e FROM tr) y ON y.tx = r.i * 3 % 20000")
def distance_tx(m, s, d):
    x = star.reads(s, d)
    return overlaps.distance(m, x, x.select("i", (F.col("i") * 3 % 20000).alias("id")), "tx")


@_query(f"""SELECT r.i AS i, CAST({_DIST} AS BIGINT) AS distance FROM reads r LEFT JOIN
(SELECT gene_id, min(gg.seqnames) AS chrom, min(gg.strand) AS strand, min(gg.start) AS s, max(gg."end") AS e FROM ({_GENES}) gg GROUP BY gene_id HAVING count(*) = 1) y ON y.gene_id = 'G' || (r.i % 3000)""")
def distance_gene(m, s, d):
    x = star.reads(s, d)
    return overlaps.distance(m, x, x.select("i", F.concat(F.lit("G"), (F.col("i") % 3000).cast("string")).alias("id")), "gene")


@_query("""SELECT i, max(x.e) AS before FROM reads r JOIN exon x ON x.chrom = r.chrom AND x.e < r.s GROUP BY i""")
def nearest_before(m, s, d):
    return intervals.nearest_before(star.reads(s, d), extract.exons(m)).select("i", F.col("hit.end").alias("before"))


@_query("""SELECT i, min(x.s) AS after FROM reads r JOIN exon x ON x.chrom = r.chrom AND x.s > r.e GROUP BY i""")
def nearest_after(m, s, d):
    return intervals.nearest_after(star.reads(s, d), extract.exons(m)).select("i", F.col("hit.start").alias("after"))


def _neighbour_sql(ahead: bool, pick: str) -> str:
    after, before = ("x.s > r.e", "x.e < r.s")
    plus, minus = (after, before) if ahead else (before, after)
    return f"""SELECT i, CAST(d AS BIGINT) AS distance, CAST({pick}(exon_id) AS BIGINT) AS exon_id FROM (SELECT i, exon_id, d, min(d) OVER (PARTITION BY i) AS least FROM
(SELECT r.i, x.exon_id, greatest(x.s - r.e, r.s - x.e) - 1 AS d FROM reads r JOIN exon x ON x.chrom = r.chrom AND ((r.strand IN ('+', '*') AND x.strand IN ('+', '*') AND {plus}) OR (r.strand IN ('-', '*') AND x.strand IN ('-', '*') AND {minus})))) WHERE d = least GROUP BY i, d"""


@_query(_neighbour_sql(True, "min"))
def precede(m, s, d):
    return intervals.precede(star.reads(s, d), extract.exons(m), "exon_id").select("i", "distance", F.col("hit.exon_id").alias("exon_id"))


@_query(_neighbour_sql(False, "max"))
def follow(m, s, d):
    return intervals.follow(star.reads(s, d), extract.exons(m), "exon_id").select("i", "distance", F.col("hit.exon_id").alias("exon_id"))


# -- derived tables ---------------------------------------------------------------
@_query("""SELECT tr.tx AS tx_id, tx_name, gene_id, coalesce(nexon, 0) AS nexon, coalesce(tx_len, 0) AS tx_len, coalesce(cds_len, 0) AS cds_len, coalesce(u5, 0) AS utr5_len, coalesce(u3, 0) AS utr3_len
FROM tr LEFT JOIN gene1 ON tr.tx = gene1.tx LEFT JOIN (SELECT tx, count(*) AS nexon, CAST(sum(e - s + 1) AS BIGINT) AS tx_len, CAST(sum(ce - cs + 1) AS BIGINT) AS cds_len FROM sp GROUP BY tx) l ON tr.tx = l.tx
LEFT JOIN (SELECT tx, CAST(sum(e - s + 1) AS BIGINT) AS u5 FROM utr5 GROUP BY tx) a ON tr.tx = a.tx LEFT JOIN (SELECT tx, CAST(sum(e - s + 1) AS BIGINT) AS u3 FROM utr3 GROUP BY tx) b ON tr.tx = b.tx""")
def transcript_lengths(m, s, d):
    return derived.transcript_lengths(m, True, True, True)


@_query("SELECT tx, CAST(sum(e - s + 1) AS BIGINT) AS width FROM sp GROUP BY tx")
def transcript_widths(m, s, d):
    lists = grouped.exons_by(m, "tx").groupBy(F.col("group_id").alias("tx")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    text = lambda c: F.array_join(F.transform("x", lambda e: e[c].cast("string")), ",")
    return lists.select("tx", derived.transcript_widths(text("start"), text("end")).alias("width"))


@_query(f"SELECT {_TX}, tx AS tx_id, tx_name, gene_id FROM tr LEFT JOIN gene1 USING (tx)")
def tidy_transcripts(m, s, d):
    return derived.tidy_transcripts(m)


@_query(f"SELECT {_RANGE}, tx AS tx_id, gene_id, exon_id, rk AS exon_rank FROM sp JOIN gene1 USING (tx)")
def tidy_exons(m, s, d):
    return derived.tidy_exons(m, drop_geneless=True).drop("tx_name", "exon_name")


@_query(f"SELECT {_RANGE}, tx AS tx_id, gene_id FROM intron LEFT JOIN gene1 USING (tx)")
def tidy_introns(m, s, d):
    return derived.tidy_introns(m).drop("tx_name")


def _segments(source: str) -> str:
    return f"""cuts AS (SELECT DISTINCT chrom, strand, p FROM (SELECT chrom, strand, s AS p FROM {source} UNION ALL SELECT chrom, strand, e + 1 FROM {source})),
seg AS (SELECT chrom, strand, p AS ps, lead(p) OVER (PARTITION BY chrom, strand ORDER BY p) - 1 AS pe FROM cuts),
part AS (SELECT g.chrom, g.strand, g.ps, g.pe, x.* EXCLUDE (chrom, strand) FROM seg g JOIN {source} x ON x.chrom = g.chrom AND x.strand = g.strand AND x.s <= g.ps AND x.e >= g.pe WHERE g.pe IS NOT NULL)"""


_PART = 'chrom AS seqnames, ps AS start, pe AS "end", strand'

@_query(f"""SELECT {_PART}, array_to_string(list_sort(list_distinct(list(tx))), ',') AS tx_id, array_to_string(list_sort(list_distinct(list(exon_id))), ',') AS exon_id,
array_to_string(list_sort(list_distinct(list(rk))), ',') AS exon_rank, coalesce(array_to_string(list_sort(list_distinct(list(gene_id) FILTER (gene_id IS NOT NULL))), ','), '') AS gene_id
FROM part LEFT JOIN ge USING (tx) GROUP BY chrom, strand, ps, pe""", _segments("sp"))
def exonic_parts(m, s, d):
    rows = derived.exonic_parts(m)
    return rows.select("seqnames", "start", "end", "strand", *[_text(c).alias(c) for c in ("tx_id", "exon_id", "exon_rank", "gene_id")])


@_query(f"""SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY seqnames, strand, start) AS exonic_part FROM (SELECT {_PART}, min(gene_id) AS gene_id, count(DISTINCT tx) AS n_tx
FROM part GROUP BY chrom, strand, ps, pe HAVING count(DISTINCT gene_id) = 1)""", "gsp AS (SELECT sp.*, gene_id FROM sp JOIN ge USING (tx))," + _segments("gsp"))
def exonic_parts_single_gene(m, s, d):
    rows = derived.exonic_parts(m, True)
    return rows.select("seqnames", "start", "end", "strand", "gene_id", F.size("tx_id").cast("long").alias("n_tx"), "exonic_part")


@_query(f"SELECT {_PART}, array_to_string(list_sort(list_distinct(list(tx))), ',') AS tx_id FROM part GROUP BY chrom, strand, ps, pe", _segments("intron"))
def intronic_parts(m, s, d):
    return derived.intronic_parts(m).select("seqnames", "start", "end", "strand", _text("tx_id").alias("tx_id"))


@_query("""SELECT tx AS group_id, rk AS exon_rank, s - CASE WHEN strand = '-' THEN aft ELSE bef END AS start, e + CASE WHEN strand = '-' THEN bef ELSE aft END AS "end"
FROM (SELECT *, CASE WHEN rk > 1 THEN 2 ELSE 0 END AS bef, CASE WHEN rk < count(*) OVER (PARTITION BY tx) THEN 2 ELSE 0 END AS aft FROM sp)""")
def extend_exons(m, s, d):
    return derived.extend_exons_into_introns(grouped.exons_by(m, "tx")).select("group_id", "exon_rank", "start", "end")


@_query("""SELECT chrom AS seqnames, strand, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM
(SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM exon)) GROUP BY chrom, strand, grp""")
def reduce_exons(m, s, d):
    return intervals.reduce_ranges(extract.exons(m))


# -- coordinates --------------------------------------------------------------
_CLIP = """pr AS (SELECT r.i, o.tx, o.strand, o.off, greatest(r.s, o.s) AS a, least(r.e, o.e) AS b, r.s AS rs, r.e AS re, o.s AS os, o.e AS oe FROM reads r JOIN {t} o ON r.chrom = o.chrom AND r.s <= o.e AND r.e >= o.s AND {strand}),
pos AS (SELECT *, CASE WHEN strand = '-' THEN off + oe - b + 1 ELSE off + a - os + 1 END AS t1, CASE WHEN strand = '-' THEN off + oe - a + 1 ELSE off + b - os + 1 END AS t2 FROM pr)"""
_STRANDED = _CLIP.format(t="offs", strand="(r.strand = o.strand OR r.strand = '*')")
_PLAIN = """offl AS (SELECT tx, chrom, '*' AS strand, s, e, coalesce(sum(e - s + 1) OVER (PARTITION BY tx ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sp),""" + _CLIP.format(t="offl", strand="true")
_MAPPED = """SELECT i, tx AS group_id, CAST(min(t1) AS BIGINT) AS start, CAST(max(t2) AS BIGINT) AS "end", min(strand) AS strand FROM pos GROUP BY i, tx HAVING max(CASE WHEN a = rs THEN 1 END) = 1 AND max(CASE WHEN b = re THEN 1 END) = 1"""


@_query(_MAPPED, _STRANDED)
def map_to_tx(m, s, d):
    return coords.map_to_transcripts(star.reads(s, d), grouped.exons_by(m, "tx")).drop("intronic")


@_query(_MAPPED, _PLAIN)
def map_to_tx_ignore_strand(m, s, d):
    return coords.map_to_transcripts(star.reads(s, d), grouped.exons_by(m, "tx"), ignore_strand=True).drop("intronic")


_WIDE = """wide AS (SELECT i, chrom, strand, s, e + 1000 AS e FROM reads),"""


@_query(_MAPPED, _WIDE + _STRANDED.replace("FROM reads r", "FROM wide r"))
def map_to_tx_span_introns(m, s, d):
    wide = star.reads(s, d).withColumn("end", F.col("end") + 1000)
    return coords.map_to_transcripts(wide, grouped.exons_by(m, "tx")).drop("intronic")


@_query(f"""SELECT i, group_id, start, "end", strand, false AS intronic FROM ({_MAPPED}) UNION ALL
SELECT r.i, n.tx, CAST(n.at + 1 AS BIGINT), CAST(n.at AS BIGINT), n.strand, true FROM reads r JOIN gp n ON r.chrom = n.chrom AND (r.strand = n.strand OR r.strand = '*') AND r.s >= n.s AND r.e <= n.e""",
        _STRANDED + """,gp AS (SELECT tx, chrom, strand, e + 1 AS s, nxt - 1 AS e, CASE WHEN strand = '-' THEN off ELSE noff END AS at FROM (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS nxt, lead(off) OVER (PARTITION BY tx ORDER BY s) AS noff FROM offs) WHERE nxt > e + 1)""")
def map_to_tx_intron_junctions(m, s, d):
    return coords.map_to_transcripts(star.reads(s, d), grouped.exons_by(m, "tx"), intron_junctions=True)


@_query("""SELECT i, tx AS group_id, CAST(t1 AS BIGINT) AS tx_start, CAST(t2 AS BIGINT) AS tx_end, a AS start, b AS "end" FROM pos""", _STRANDED)
def project_on_tx(m, s, d):
    return coords.project_on_transcripts(star.reads(s, d), grouped.exons_by(m, "tx")).select("i", "group_id", "tx_start", "tx_end", "start", "end")


@_query("""SELECT q.i, q.tx AS group_id, coalesce(h.start, 0) AS start, coalesce(h."end", -1) AS "end", coalesce(h.strand, '*') AS strand FROM qq q LEFT JOIN (
SELECT q.i, q.tx, q.p - o.s + 1 AS x, CAST(CASE WHEN o.strand = '-' THEN o.off + o.e - q.p - 9 + 1 ELSE o.off + q.p - o.s + 1 END AS BIGINT) AS start, CAST(CASE WHEN o.strand = '-' THEN o.off + o.e - q.p + 1 ELSE o.off + q.p + 9 - o.s + 1 END AS BIGINT) AS "end", o.strand
FROM qq q JOIN offs o ON o.tx = q.tx AND q.p >= o.s AND q.p + 9 <= o.e) h ON h.i = q.i""", "qq AS (SELECT tx AS i, tx, min(s) + tx % 160 AS p FROM sp GROUP BY tx)")
def pmap_to_tx(m, s, d):
    e = grouped.exons_by(m, "tx")
    firsts = e.groupBy("group_id").agg(F.min("start").alias("first"), F.min("seqnames").alias("seqnames"), F.min("strand").alias("strand"))
    x = firsts.select(F.col("group_id").alias("i"), "seqnames", (F.col("first") + F.col("group_id") % 160).alias("start"), (F.col("first") + F.col("group_id") % 160 + 9).alias("end"), "strand")
    return coords.pmap_to_transcripts(x, e.withColumn("i", F.col("group_id")))


_BACK = """tq AS (SELECT tx AS i, tx, 1 + tx % 300 AS a, 1 + tx % 300 + 49 AS b FROM tr),
ends AS (SELECT q.i, q.tx, o.chrom, o.strand, max(CASE WHEN q.a > off AND q.a <= off + o.e - o.s + 1 THEN CASE WHEN strand = '-' THEN o.e - (q.a - off - 1) ELSE o.s + (q.a - off - 1) END END) AS ga,
max(CASE WHEN q.b > off AND q.b <= off + o.e - o.s + 1 THEN CASE WHEN strand = '-' THEN o.e - (q.b - off - 1) ELSE o.s + (q.b - off - 1) END END) AS gb FROM tq q JOIN offs o USING (tx) GROUP BY q.i, q.tx, o.chrom, o.strand)"""


def _tx_ranges(m: GeneModel) -> DataFrame:
    k = F.col("_tx_id")
    return m["transcript"].select(k.alias("i"), k.alias("group_id"), (k % 300 + 1).alias("start"), (k % 300 + 50).alias("end"), F.lit("*").alias("strand"))


@_query("""SELECT i, tx AS group_id, chrom AS seqnames, CAST(least(ga, gb) AS BIGINT) AS start, CAST(greatest(ga, gb) AS BIGINT) AS "end", strand FROM ends WHERE ga IS NOT NULL AND gb IS NOT NULL""", _BACK)
def map_from_tx(m, s, d):
    return coords.map_from_transcripts(_tx_ranges(m), grouped.exons_by(m, "tx"))


@_query("""SELECT tq.i, CASE WHEN ga IS NULL OR gb IS NULL THEN 'UNMAPPED' ELSE chrom END AS seqnames, CAST(CASE WHEN ga IS NULL OR gb IS NULL THEN 0 ELSE least(ga, gb) END AS BIGINT) AS start,
CAST(CASE WHEN ga IS NULL OR gb IS NULL THEN -1 ELSE greatest(ga, gb) END AS BIGINT) AS "end", CASE WHEN ga IS NULL OR gb IS NULL THEN '*' ELSE strand END AS strand FROM tq LEFT JOIN ends ON tq.i = ends.i""", _BACK)
def pmap_from_tx(m, s, d):
    return coords.pmap_from_transcripts(_tx_ranges(m), grouped.exons_by(m, "tx").withColumn("i", F.col("group_id")))


@_query("""SELECT tx AS group_id, loc, CAST(max(CASE WHEN loc > off AND loc <= off + e - s + 1 THEN CASE WHEN strand = '-' THEN e - (loc - off - 1) ELSE s + (loc - off - 1) END END) AS BIGINT) AS ref
FROM offs JOIN (VALUES (1), (120), (333)) v(loc) ON true GROUP BY tx, loc""")
def tx_locs_to_ref(m, s, d):
    e = grouped.exons_by(m, "tx")
    locs = e.select("group_id").distinct().withColumn("loc", F.explode(F.array(F.lit(1), F.lit(120), F.lit(333)))).withColumn("i", F.col("group_id"))
    return coords.transcript_locs_to_ref_locs(locs, e, error_if_out_of_bounds=False).select("group_id", "loc", "ref")


_CDS_OFF = """co AS (SELECT tx, chrom, strand, cs AS s, ce AS e, row_number() OVER w AS nth, count(*) OVER (PARTITION BY tx) AS parts, sum(ce - cs + 1) OVER (PARTITION BY tx) AS total,
coalesce(sum(ce - cs + 1) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -cs ELSE cs END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sp WHERE cds_id IS NOT NULL
WINDOW w AS (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -cs ELSE cs END)),
pq AS (SELECT *, 3 * (a - 1) + 1 AS f, 3 * b AS t, e - s + 1 AS w FROM co JOIN (VALUES (2, 20)) v(a, b) ON true WHERE total >= 4),
pl AS (SELECT *, CASE WHEN t > total THEN nth = parts ELSE t > off AND t <= off + w END AS lst, f > off AND f <= off + w AS fst FROM pq WHERE off + w >= f AND off < t)"""


@_query("""SELECT tx AS group_id, CAST(CASE WHEN strand = '-' THEN s + cut ELSE s + skip END AS BIGINT) AS start, CAST(CASE WHEN strand = '-' THEN e - skip ELSE e - cut END AS BIGINT) AS "end",
CAST(CASE WHEN fst THEN a ELSE off // 3 + 1 END AS BIGINT) AS protein_start, CAST(CASE WHEN lst THEN b ELSE (off + w + 2) // 3 END AS BIGINT) AS protein_end
FROM (SELECT *, greatest(0, f - off - 1) AS skip, CASE WHEN lst THEN off + w - t ELSE 0 END AS cut FROM pl)""", _CDS_OFF)
def protein_to_genome(m, s, d):
    c = grouped.cds_by(m, "tx")
    fit = c.groupBy("group_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n")).where("n >= 4")
    x = fit.select(F.col("group_id").alias("i"), "group_id", F.lit(2).cast("long").alias("start"), F.lit(20).cast("long").alias("end"))
    return coords.protein_to_genome(x, c).select("group_id", "start", "end", "protein_start", "protein_end")


# -- coverage ------------------------------------------------------------------
def _coverage_sql(strand: str) -> str:
    return f"""SELECT tx AS group_id, CAST(sum(e - s + 1) AS BIGINT) AS width, CAST(coalesce(sum(cov), 0) AS BIGINT) AS covered FROM (SELECT x.tx, x.exon_id, x.s, x.e, sum(CASE WHEN r.i IS NOT NULL THEN least(r.e, x.e) - greatest(r.s, x.s) + 1 END) AS cov
FROM sp x LEFT JOIN reads r ON r.chrom = x.chrom AND r.s <= x.e AND r.e >= x.s AND {strand} GROUP BY x.tx, x.exon_id, x.s, x.e) GROUP BY tx"""


def _summed(runs: DataFrame) -> DataFrame:
    w = F.col("end") - F.col("start") + 1
    return runs.groupBy("group_id").agg(F.sum(w).alias("width"), F.sum(w * F.col("depth")).cast("long").alias("covered"))


@_query(_coverage_sql("(r.strand = x.strand OR r.strand = '*')"))
def coverage_by_tx(m, s, d):
    return _summed(coverage.coverage_by_transcript(star.reads(s, d), grouped.exons_by(m, "tx").select("group_id", *intervals.CORE)))


@_query(_coverage_sql("true"))
def coverage_by_tx_ignore_strand(m, s, d):
    return _summed(coverage.coverage_by_transcript(star.reads(s, d), grouped.exons_by(m, "tx").select("group_id", *intervals.CORE), ignore_strand=True))


@_query("""SELECT tx AS group_id, CAST(t AS BIGINT) AS position, count(r.i) AS depth FROM (SELECT tx, chrom, strand, off + CASE WHEN strand = '-' THEN e - p + 1 ELSE p - s + 1 END AS t, p
FROM (SELECT *, unnest(range(s, e + 1)) AS p FROM offs)) b LEFT JOIN reads r ON r.chrom = b.chrom AND r.s <= b.p AND r.e >= b.p AND (r.strand = b.strand OR r.strand = '*') GROUP BY tx, t HAVING count(r.i) > 0""")
def coverage_positions(m, s, d):
    e = grouped.exons_by(m, "tx").select("group_id", *intervals.CORE)
    runs = coverage.coverage_by_transcript(star.reads(s, d), e).where("depth > 0")
    return runs.select("group_id", F.explode(F.sequence("start", "end")).alias("position"), "depth")


@_query(_coverage_sql("(r.strand = x.strand OR r.strand = '*') AND r.i % 5 = x.tx % 5"))
def pcoverage_by_tx(m, s, d):
    e = grouped.exons_by(m, "tx").select("group_id", *intervals.CORE, (F.col("group_id") % 5).alias("i"))
    return _summed(coverage.pcoverage_by_transcript(star.reads(s, d).withColumn("i", F.col("i") % 5), e))


# -- sequences -----------------------------------------------------------------
_SEQ = f"""SELECT tr.tx AS group_id, md5(coalesce(q.seq, '')) AS digest, CAST(length(coalesce(q.seq, '')) AS BIGINT) AS width FROM tr LEFT JOIN (SELECT tx, string_agg(CASE WHEN strand = '-' THEN {RC.format(b=BASE)} ELSE {BASE} END, '' ORDER BY rk, CASE WHEN strand = '-' THEN -p ELSE p END) AS seq
FROM (SELECT *, unnest(range(s, e + 1)) AS p FROM sp) GROUP BY tx) q ON tr.tx = q.tx"""


def _digest(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.md5(F.coalesce("seq", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("seq", F.lit(""))).cast("long").alias("width"))


@_query(_SEQ)
def extract_tx_seqs(m, s, d):
    e = grouped.exons_by(m, "tx")
    return _digest(sequences.model_transcript_seqs(m, e, star.genome(m, e), star.CHUNK), "group_id")


@_query(_SEQ)
def extract_tx_seqs_from_fasta(m, s, d):
    """The whole genome written as FASTA, read back by position and cut."""
    folder = f"{store.shared_folder(s)}/genome-{uuid.uuid4().hex}"
    genome.write_fasta(star.genome(m), f"{folder}/fasta", width=500, parts=star.genome_parts(m))
    parts = genome.fasta_parts(s, f"{folder}/fasta")
    chunks = genome.store_chunks(genome.read_fasta(s, f"{folder}/fasta", star.CHUNK, parts), f"{folder}/chunks", parts)
    return _digest(sequences.model_transcript_seqs(m, grouped.exons_by(m, "tx"), chunks, star.CHUNK), "group_id")


def _range_seq_sql(ranges: str, key: str) -> str:
    return f"""SELECT {key}, md5(string_agg(CASE WHEN strand = '-' THEN {RC.format(b=BASE)} ELSE {BASE} END, '' ORDER BY CASE WHEN strand = '-' THEN -p ELSE p END)) AS digest, count(*) AS width
FROM (SELECT *, unnest(range(s, e + 1)) AS p FROM ({ranges})) GROUP BY {key}"""


_LEN = "(SELECT max(te) + 5000 FROM tr)"


@_query(_range_seq_sql(f"""SELECT gene_id AS group_id, seqnames AS chrom, strand, greatest(1, CASE WHEN strand = '-' THEN "end" + 1 ELSE start - 1000 END) AS s, least({_LEN}, CASE WHEN strand = '-' THEN "end" + 1000 ELSE start - 1 END) AS e
FROM ({_GENES}) WHERE gene_id IN (SELECT gene_id FROM ({_GENES}) GROUP BY 1 HAVING count(*) = 1)""", "group_id"))
def upstream_seqs(m, s, d):
    g = extract.genes(m).withColumnRenamed("gene_id", "group_id")
    lengths = m["chrominfo"].select(F.col("chrom").alias("seqnames"), "length")
    chunks = star.genome(m, sequences.upstream_ranges(g, lengths, 1000))
    return _digest(sequences.extract_upstream_seqs(g, chunks, lengths, star.CHUNK, 1000), "group_id").where("width > 0")


def _around_sql(plus: str, minus: str) -> str:
    lo, hi = (f"CASE WHEN strand = '-' THEN {a} ELSE {b} END" for a, b in zip(minus.split("|"), plus.split("|"), strict=True))
    return _range_seq_sql(f"SELECT tx AS i, chrom, strand, greatest(1, {lo}) AS s, least({_LEN}, {hi}) AS e FROM tr", "i")


def _around(m: GeneModel, which: str) -> DataFrame:
    tx = extract.transcripts(m, ("tx_id",)).withColumnRenamed("tx_id", "i").withColumn("group_id", F.lit(None).cast("string"))
    chunks = star.genome(m, sequences.around_ranges(tx, which, 300, 50))
    return _digest(sequences.around_sequences(tx, chunks, star.CHUNK, which, 300, 50), "i")


@_query(_around_sql("ts - 300|ts + 49", "te - 49|te + 300"))
def promoter_seqs(m, s, d):
    return _around(m, "promoter")


@_query(_around_sql("te - 300|te + 49", "ts - 49|ts + 300"))
def terminator_seqs(m, s, d):
    return _around(m, "terminator")


# -- keyed lookup ----------------------------------------------------------------
def _values(keys: list[str]) -> str:
    return f"(VALUES {', '.join(f'({i}, {k!r})' for i, k in enumerate(keys))}) k(i, key)"


@_query(f"""SELECT CAST(k.i AS INTEGER) AS i, k.key AS "GENEID", x.tx AS "TXID", x.tx_name AS "TXNAME" FROM {_values(_KEYS)} LEFT JOIN (SELECT DISTINCT gene_id, tx, tx_name FROM ge JOIN tr USING (tx)) x ON x.gene_id = k.key""")
def select_by_gene(m, s, d):
    return keyed.select(m, _KEYS, ["TXID", "TXNAME"], "GENEID")


_TXIDS = ["12", "5", "999999999", "37", "5"]


@_query(f"""SELECT CAST(k.i AS INTEGER) AS i, k.key AS "TXID", x.exon_id AS "EXONID", x.rk AS "EXONRANK", x.cds_id AS "CDSID", x.gene_id AS "GENEID" FROM {_values(_TXIDS)} LEFT JOIN (SELECT DISTINCT sp.tx, exon_id, rk, cds_id, gene_id FROM sp LEFT JOIN ge ON ge.tx = sp.tx) x ON CAST(x.tx AS VARCHAR) = k.key""")
def select_by_txid(m, s, d):
    return keyed.select(m, _TXIDS, ["EXONID", "EXONRANK", "CDSID", "GENEID"], "TXID")


@_query("SELECT DISTINCT gene_id AS key FROM ge WHERE regexp_matches(gene_id, '^G1.*7$')")
def keys_pattern(m, s, d):
    return keyed.keys(m, "GENEID", "^G1.*7$")


@_query("SELECT DISTINCT CAST(tx AS VARCHAR) AS key FROM ge JOIN tr USING (tx) WHERE regexp_matches(gene_id, '^G10')")
def keys_by_column(m, s, d):
    return keyed.keys(m, "TXID", "^G10", "GENEID")


@_query("""SELECT key FROM (SELECT DISTINCT key, l, unnest(range(1, length(key) + 1)) AS i FROM (SELECT DISTINCT tx_name AS key FROM tr WHERE tx_name IS NOT NULL) k, (VALUES (3), (4), (5)) v(l))
GROUP BY key HAVING min(levenshtein(substr(key, CAST(i AS BIGINT), CAST(l AS BIGINT)), 'T123')) <= 1""")
def keys_fuzzy(m, s, d):
    return keyed.keys(m, "TXNAME", "T123", fuzzy=True)


@_query("""SELECT DISTINCT gene_id AS key FROM ge JOIN tr USING (tx) WHERE tx_name IN (SELECT key FROM (SELECT DISTINCT key, l, unnest(range(1, length(key) + 1)) AS i FROM (SELECT DISTINCT tx_name AS key FROM tr WHERE tx_name IS NOT NULL) k, (VALUES (2), (3), (4), (5), (6)) v(l))
GROUP BY key HAVING min(levenshtein(substr(key, CAST(i AS BIGINT), CAST(l AS BIGINT)), '9999')) <= 2)""")
def keys_fuzzy_by_column(m, s, d):
    return keyed.keys(m, "GENEID", "9999", "TXNAME", fuzzy=True, edits=2)


def _named_counts(table: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({e}) AS n_values, count(DISTINCT {e}) AS n_keys FROM {table}" for c, e in names.items())


# The public names of the model's columns, by the SQL of their values, and the key types.
_TR = {"TXID": "tx", "TXNAME": "tx_name", "TXTYPE": "NULL", "TXCHROM": "chrom", "TXSTRAND": "strand", "TXSTART": "ts", "TXEND": "te"}
_SP = {"EXONRANK": "rk", "CDSPHASE": "NULL"}
_EX = {"EXONID": "exon_id", "EXONNAME": "NULL", "EXONCHROM": "chrom", "EXONSTRAND": "strand", "EXONSTART": "s", "EXONEND": "e"}
_CD = {"CDSID": "cds_id", "CDSNAME": "NULL", "CDSCHROM": "chrom", "CDSSTRAND": "strand", "CDSSTART": "cs", "CDSEND": "ce"}
_KEYTYPES = "CDSID CDSNAME EXONID EXONNAME GENEID TXID TXNAME".split()
_COUNTS = " UNION ALL ".join(_named_counts(t, n) for t, n in (("tr", _TR), ("sp", _SP), ("exon", _EX), ("cdsd", _CD), ("ge", {"GENEID": "gene_id"})))


@_query(f"SELECT * FROM ({_COUNTS})")
def columns(m, s, d):
    return keyed.value_counts(m).drop("keytype")


@_query(f"SELECT \"column\" AS keytype, n_keys FROM ({_COUNTS}) WHERE \"column\" IN ({', '.join(map(repr, _KEYTYPES))})")
def keytypes(m, s, d):
    return keyed.value_counts(m).where("keytype").select(F.col("column").alias("keytype"), "n_keys")


@_query(f"""SELECT CAST(k.i AS INTEGER) AS i, k.key AS "TXID", x.chrom AS "TXCHROM" FROM {_values(_TXIDS)} LEFT JOIN (SELECT tx, chrom FROM tr WHERE chrom IN ('chr2', 'chr3')) x ON CAST(x.tx AS VARCHAR) = k.key""")
def active_seqs_select(m, s, d):
    return keyed.select(m.with_active(["chr2", "chr3"]), _TXIDS, ["TXCHROM"], "TXID")


# -- chromosomes, dumps, formats ------------------------------------------------------
@_query(f"SELECT {_TX}, tx AS tx_id, tx_name FROM tr WHERE chrom IN ('chr2', 'chr5')")
def seqlevels_subset(m, s, d):
    return extract.transcripts(m.with_seqlevels(["chr5", "chr2"]))


@_query(f"SELECT '2' AS seqnames, s AS start, e AS \"end\", strand, exon_id FROM exon WHERE chrom = 'chr2'")
def seqlevels_rename(m, s, d):
    return extract.exons(m.with_seqlevels({"chr2": "2"}))


@_query(f"SELECT 'chr' || k AS seqnames, {_LEN} AS seqlengths, false AS \"isCircular\" FROM (SELECT unnest(range(1, 21)) AS k)")
def seqinfo(m, s, d):
    return m.seqinfo().select("seqnames", "seqlengths", "isCircular")


@_query("SELECT tx AS tx_id, rk AS exon_rank, exon_id, chrom AS exon_chrom, s AS exon_start, cds_id, cs AS cds_start FROM sp")
def dump_splicings(m, s, d):
    return m.dump()["splicings"].select("tx_id", "exon_rank", "exon_id", "exon_chrom", "exon_start", "cds_id", "cds_start")


@_query("""SELECT sp.chrom, min(s) - 1 AS "chromStart", max(e) AS "chromEnd", min(tx_name) AS name, min(sp.strand) AS strand, min(cs) - 1 AS "thickStart", max(ce) AS "thickEnd", CAST(count(*) AS INTEGER) AS "blockCount",
string_agg(CAST(e - s + 1 AS VARCHAR), ',' ORDER BY s) AS "blockSizes", string_agg(CAST(s - f AS VARCHAR), ',' ORDER BY s) AS "blockStarts"
FROM (SELECT *, min(s) OVER (PARTITION BY tx) AS f FROM sp) sp JOIN tr USING (tx) GROUP BY tx, sp.chrom HAVING min(cs) IS NOT NULL""")
def as_bed(m, s, d):
    return sinks.as_bed(m).drop("score", "itemRgb")


@_query(f"""SELECT seqnames, start, "end", strand, 'gene' AS type, 'GeneID:' || gene_id AS "ID", '' AS parent FROM ({_GENES}) WHERE gene_id IN (SELECT gene_id FROM ({_GENES}) GROUP BY 1 HAVING count(*) = 1)
UNION ALL SELECT chrom, ts, te, strand, 'mRNA', 'TxID:' || tx, coalesce((SELECT string_agg('GeneID:' || gene_id, ',' ORDER BY gene_id) FROM ge WHERE ge.tx = tr.tx), '') FROM tr
UNION ALL SELECT chrom, s, e, strand, 'exon', '', 'TxID:' || tx FROM sp UNION ALL SELECT chrom, cs, ce, strand, 'CDS', '', 'TxID:' || tx FROM sp WHERE cds_id IS NOT NULL""")
def as_gff(m, s, d):
    return sinks.as_gff(m).select("seqnames", "start", "end", "strand", "type", F.coalesce("ID", F.lit("")).alias("ID"), F.array_join("Parent", ",").alias("parent"))


@_query(f"""SELECT strftime(date_trunc('day', v.ts), '%Y-%m-%d') AS day, r.chrom AS seqnames, count(*) AS n_overlaps FROM reads r JOIN events v ON v.event_id = r.i JOIN exon x ON {_ANY} GROUP BY 1, 2""")
def stream_overlap_counts(m, s, d):
    from strandline.streaming.reads import overlap_counts_of

    return overlap_counts_of(s, d, extract.exons(m))


# -- whole models ----------------------------------------------------------------
@_query("SELECT name, value, (SELECT count(*) FROM tr) AS n_transcripts FROM (VALUES ('Genome', 'made-up'), ('Organism', 'Ordo lineatus'), ('Source', 'orders and lineitem'), ('Schema version', '1.2')) v(name, value)")
def genome_info(m, s, d):
    """What a written extractor result tells of the model it came from."""
    path = f"{store.shared_folder(s)}/transcripts-{uuid.uuid4().hex}"
    extract.transcripts(m).write.parquet(path)
    back = s.read.parquet(path).join(m["gene"].select(F.col("_tx_id").alias("tx_id")).distinct(), "tx_id", "left")
    told = s.createDataFrame(sorted(model.genome_info(back).items()), "name string, value string")
    return back.groupBy().agg(F.count(F.lit(1)).alias("n_transcripts")).join(F.broadcast(told), F.lit(True)).select("name", "value", "n_transcripts")


@_query("""SELECT tr.chrom, count(DISTINCT tr.tx) AS n_tx, count(DISTINCT gene_id) AS n_genes, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS n_exons FROM tr LEFT JOIN (SELECT tx, min(gene_id) AS gene_id FROM ge GROUP BY tx) g USING (tx)
LEFT JOIN (SELECT tx, count(*) AS n FROM sp GROUP BY tx) x USING (tx) GROUP BY tr.chrom""")
def sql_over_model(m, s, d):
    return m.sql("""SELECT t.tx_chrom AS chrom, count(DISTINCT t._tx_id) AS n_tx, count(DISTINCT gene_id) AS n_genes, coalesce(sum(x.n), 0) AS n_exons FROM {transcript} t
        LEFT JOIN (SELECT _tx_id, min(gene_id) AS gene_id FROM {gene} GROUP BY _tx_id) g ON g._tx_id = t._tx_id
        LEFT JOIN (SELECT _tx_id, count(*) AS n FROM {splicing} GROUP BY _tx_id) x ON x._tx_id = t._tx_id GROUP BY t.tx_chrom""")


def _damaged(m, s):
    """A copy of the model in another folder: ends moved, links and chromosomes
    lost, rows twice."""
    path = f"{store.shared_folder(s)}/damaged-{uuid.uuid4().hex}"
    t = dict(m.tables.items())
    t["transcript"] = t["transcript"].withColumn("tx_end", F.col("tx_end") + F.when(F.col("_tx_id") % 101 == 0, 1).otherwise(0)).where("_tx_id % 103 <> 0")
    t["gene"] = t["gene"].union(t["gene"].where("gene_id LIKE '%77'"))
    t["chrominfo"] = t["chrominfo"].where("chrom <> 'chr3'")
    model.GeneModel.from_tables(t).save(path)
    return model.GeneModel.load(s, path)


@_query("""SELECT * FROM (SELECT 'transcripts' AS "table", count(*) AS n_left, count(*) FILTER (tx % 103 <> 0) AS n_right, false AS same, count(*) FILTER (tx % 101 = 0 OR tx % 103 = 0) AS only_left, count(*) FILTER (tx % 101 = 0 AND tx % 103 <> 0) AS only_right FROM tr
UNION ALL SELECT 'splicings', count(*), count(*), true, 0, 0 FROM sp
UNION ALL SELECT 'genes', count(*), count(*) + count(*) FILTER (gene_id LIKE '%77'), count(*) FILTER (gene_id LIKE '%77') = 0, 0, count(*) FILTER (gene_id LIKE '%77') FROM ge
UNION ALL SELECT 'chrominfo', 20, 19, false, 1, 0)""")
def compare_models(m, s, d):
    return m.compared(_damaged(m, s))


@_query("""SELECT "check", CAST(missing AS BIGINT) AS missing, CAST(repeated AS BIGINT) AS repeated FROM (
SELECT 'transcript id' AS "check", 0 AS missing, 0 AS repeated UNION ALL SELECT 'exon id', 0, 0 UNION ALL SELECT 'cds id', 0, 0 UNION ALL SELECT 'splicing key', 0, 0 UNION ALL SELECT 'splicing._exon_id', 0, 0 UNION ALL SELECT 'splicing._cds_id', 0, 0
UNION ALL SELECT 'transcript.tx_chrom', 1, 0 UNION ALL SELECT 'exon.exon_chrom', 1, 0 UNION ALL SELECT 'cds.cds_chrom', 1, 0
UNION ALL SELECT 'splicing._tx_id', count(DISTINCT tx), 0 FROM sp WHERE tx % 103 = 0 UNION ALL SELECT 'gene._tx_id', count(DISTINCT tx), 0 FROM ge WHERE tx % 103 = 0 UNION ALL SELECT 'gene key', 0, count(*) FROM ge WHERE gene_id LIKE '%77')""")
def key_report(m, s, d):
    return schema.key_report(_damaged(m, s).tables)


@_query(f"""SELECT chrom AS seqnames, coalesce(CASE WHEN CAST(substr(chrom, 4) AS BIGINT) % 3 = 0 THEN 500000 + CAST(substr(chrom, 4) AS BIGINT) END, max(e)) AS length
FROM (SELECT chrom, e FROM reads UNION ALL SELECT chrom, e FROM sp) GROUP BY chrom""")
def seqlengths_inferred(m, s, d):
    """Lengths told by one of two dictionaries, or else by reads and exons."""
    info = m.seqinfo().withColumn("seqlengths", F.lit(None).cast("long"))
    told = m.seqinfo().withColumn("seqlengths", F.when(F.col("rank") % 3 == 0, 500_000 + F.col("rank")))
    return coverage.seqlengths(coverage.merged_seqinfo(info, told), star.reads(s, d), grouped.exons_by(m, "tx"))


@_query(_coverage_sql("(r.strand = x.strand OR r.strand = '*')").replace("JOIN reads r", "JOIN (SELECT i, chrom, s, least(e, 500000) AS e, strand FROM reads WHERE s <= 500000) r"))
def coverage_trimmed(m, s, d):
    """Reads count inside their chromosome only."""
    lengths = m.seqinfo().select("seqnames", F.lit(500_000).cast("long").alias("length"))
    return _summed(coverage.coverage_by_transcript(star.reads(s, d), grouped.exons_by(m, "tx").select("group_id", *intervals.CORE), lengths=lengths))


@_query(f"SELECT 'new_chr' || k AS seqnames, {_LEN} AS seqlengths, false AS \"isCircular\", 'genome ' || k AS genome, CAST(21 - k AS INTEGER) AS rank FROM (SELECT unnest(range(1, 21)) AS k)")
def seqinfo_replaced(m, s, d):
    """Levels renamed and turned round, each with a genome of its own."""
    now = m.seqinfo()
    new = now.withColumns({"seqnames": F.concat(F.lit("new_"), "seqnames"), "genome": F.concat(F.lit("genome "), F.substring("seqnames", 4, 9)), "rank": 21 - F.col("rank")})
    return m.with_seqinfo(new, list(range(20, 0, -1))).seqinfo().withColumn("rank", F.col("rank") + 1)
