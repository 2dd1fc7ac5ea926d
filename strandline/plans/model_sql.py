"""The derived gene model in plain SQL, for the twins of the queries."""

MODEL = """
WITH slots AS (SELECT l_orderkey AS tx, CAST(l_linenumber AS BIGINT) AS slot, max(l_suppkey) AS a, max(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
place AS (SELECT tx, g, 'chr' || (g % 20 + 1) AS chrom, CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand, (g // 20) * 8000 + 1 AS base
  FROM (SELECT o_orderkey AS tx, o_orderkey // 5 AS g FROM orders)),
ex0 AS (SELECT p.*, slot, base + slot * 1000 + (a % 3) * 10 AS s, base + slot * 1000 + (a % 3) * 10 + 99 + (q % 3) * 50 AS e FROM slots JOIN place p USING (tx)),
ex1 AS (SELECT *, CASE WHEN tx % 4 <> 0 AND greatest(s, base + 2025) <= least(e, base + 5120) THEN greatest(s, base + 2025) END AS cs,
  CASE WHEN tx % 4 <> 0 AND greatest(s, base + 2025) <= least(e, base + 5120) THEN least(e, base + 5120) END AS ce FROM ex0),
ex2 AS (SELECT tx, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN slot ELSE -slot END) AS rk,
  dense_rank() OVER (ORDER BY chrom, strand, s, e) AS exon_id, chrom, strand, s, e, cs, ce FROM ex1),
cdsd AS (SELECT chrom, strand, cs, ce, row_number() OVER (ORDER BY chrom, strand, cs, ce) AS cds_id FROM (SELECT DISTINCT chrom, strand, cs, ce FROM ex2 WHERE cs IS NOT NULL)),
sp AS (SELECT x.*, c.cds_id FROM ex2 x LEFT JOIN cdsd c ON x.chrom = c.chrom AND x.strand = c.strand AND x.cs = c.cs AND x.ce = c.ce),
tr AS (SELECT p.tx, CASE WHEN p.tx % 13 <> 0 THEN 'T' || p.tx END AS tx_name, p.chrom, p.strand, coalesce(min(x.s), min(p.base)) AS ts, coalesce(max(x.e), min(p.base) + 99) AS te
  FROM place p LEFT JOIN sp x ON p.tx = x.tx GROUP BY p.tx, p.chrom, p.strand),
ge AS (SELECT tx, 'G' || g AS gene_id FROM place WHERE g % 11 <> 0 UNION ALL SELECT tx, 'G' || (g + 1) FROM place WHERE g % 11 <> 0 AND tx % 37 = 0),
exon AS (SELECT DISTINCT exon_id, chrom, strand, s, e FROM sp),
reads AS (SELECT event_id AS i, 'chr' || (user_id % 20 + 1) AS chrom, (event_id * 7919) % 1200000 + 1 AS s, (event_id * 7919) % 1200000 + 50 + event_id % 100 AS e,
  CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand FROM events),
gene1 AS (SELECT tx, string_agg(gene_id, ',' ORDER BY gene_id) AS gene_id FROM ge GROUP BY tx),
utr AS (SELECT *, min(CASE WHEN cds_id IS NOT NULL THEN rk END) OVER (PARTITION BY tx) AS fc, max(CASE WHEN cds_id IS NOT NULL THEN rk END) OVER (PARTITION BY tx) AS lc FROM sp),
utr5 AS (SELECT * FROM (SELECT tx, exon_id, rk, chrom, strand, CASE WHEN rk = fc AND strand = '-' THEN ce + 1 ELSE s END AS s, CASE WHEN rk = fc AND strand = '+' THEN cs - 1 ELSE e END AS e FROM utr WHERE fc IS NOT NULL AND rk <= fc) WHERE e >= s),
utr3 AS (SELECT * FROM (SELECT tx, exon_id, rk, chrom, strand, CASE WHEN rk = lc AND strand = '+' THEN ce + 1 ELSE s END AS s, CASE WHEN rk = lc AND strand = '-' THEN cs - 1 ELSE e END AS e FROM utr WHERE lc IS NOT NULL AND rk >= lc) WHERE e >= s),
intron AS (SELECT tx, chrom, strand, e + 1 AS s, nxt - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY tx ORDER BY s) AS nxt FROM sp) WHERE nxt > e + 1),
offs AS (SELECT *, coalesce(sum(e - s + 1) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sp),
"""


def sql(body: str, more: str = "") -> str:
    """A query over the model: ``more`` are further common tables."""
    return MODEL + (more + "," if more else "") + "last AS (SELECT 1 AS one)\n" + body


#: Base of the made-up genome at a position of a chromosome.
BASE = "substr('ACGT', CAST((p * 7 + p // 3 + CAST(substr(chrom, 4) AS BIGINT)) % 4 + 1 AS BIGINT), 1)"
RC = "CASE {b} WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' ELSE 'A' END"
