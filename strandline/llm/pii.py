"""Personal data: four base detectors, and bootstrapped contextual extraction.

The base detectors find e-mail addresses, IPv4 addresses, payment cards and
phone numbers. Their finds are seed entities. The words to the left of a seed
are a lexical pattern; identifier-like tokens that no detector knows are
unseen instances. Patterns and instances form a graph in which, round by round,
a pattern scores by the kinds of its known instances and an instance by the
patterns that reach it. Instances that trusted patterns vouch for become known,
teach new patterns in the next round, and are
added to the spans. All of it is DataFrame work; the graph has one edge for
each distinct (pattern, value), counted with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import dropped, written
from strandline.llm.spans import joined, luhn, matches, only_digits, run_start

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The detectors' patterns, guarded and possessive (fixed values).
PATTERNS = {
    "email": run_start(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": run_start("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of unseen identifiers: number groups, spelled-out addresses, IPv6.
UNSEEN = (
    r"(?<![A-Za-z0-9+.])\(?[0-9][0-9 ().-]{5,}[0-9](?![A-Za-z0-9])"
    rf"|(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
    r"|(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"
)
MIN_SEEDS = 5
MIN_SCORE = 0.9
#: A context of whose values fewer than this share are known is too loose to vouch.
MIN_SHARE = 0.05
_BASE = "array<struct<k:int,s:int,e:int,m:string,l:string>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    n = F.length(only_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(only_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _guard(kind: str, text: Column) -> Column:
    mark = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    return mark.get(kind, F.regexp_like(text, F.lit("[0-9]")))


def base_spans(text: Column) -> Column:
    """array<struct<k,s,e,m,l>> of the base detectors, by kind, then start."""
    return F.concat(*[_kind_spans(text, k) for k in range(len(KINDS))])


def _kind_spans(text: Column, k: int) -> Column:
    kind = KINDS[k]
    spans = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
    kept = F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"], x["e"], x["m"], x["l"]))
    return F.when(_guard(kind, text), kept.cast(_BASE)).otherwise(F.array().cast(_BASE))


def _of_kind(spans: Column, k: int) -> Column:
    return F.filter(spans, lambda x: x["k"] == k)


def _pattern(left: Column) -> Column:
    """The last two words left of a find, lower-cased, digits as 0; null where
    there are not two words with letters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(left), r"[\x20\x09-\x0D]+", " ")), " ")
    two = F.array_join(F.slice(words, -2, 2), " ")
    return F.when((F.size(words) >= 2) & F.regexp_like(two, F.lit(r"\p{L}.* .*\p{L}")), F.regexp_replace(two, "[0-9]", "0"))


def _shapes(m: Column) -> Column:
    """The kinds whose shape a token has."""
    n = F.length(only_digits(m))
    plain = F.regexp_like(m, F.lit("^[0-9 ().-]+$"))
    fits = [~plain & F.contains(F.lower(m), F.lit("at")), ~plain & F.contains(m, F.lit(":")), plain & n.between(13, 19), plain & n.between(7, 15)]
    return F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, ``text hash``, ``base`` and ``unseen`` spans of every row: the one
    pass over the texts. Null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", F.xxhash64("t").alias("text hash"), "t", base_spans(F.col("t")).alias("base"))
    maybe = F.regexp_like("t", F.lit(r"[0-9]|[\[(]at[\])]|::"))
    free = F.filter(
        matches(F.col("t"), UNSEEN),
        lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
    )
    shaped = F.filter(F.transform(free, lambda x: F.struct(x["s"], x["e"], x["m"], x["l"], _shapes(x["m"]).alias("kinds"))), lambda x: F.size(x["kinds"]) > 0)
    kind = "array<struct<s:int,e:int,m:string,l:string,kinds:array<int>>>"
    return rows.select("doc_id", "text hash", "base", F.when(maybe, shaped.cast(kind)).otherwise(F.array().cast(kind)).alias("unseen"))


def graph(scan: DataFrame) -> DataFrame:
    """Distinct edges (pattern, k, value, seed) between contexts and entities."""
    seeds = scan.select(F.explode("base").alias("x")).select(_pattern(F.col("x.l")).alias("pattern"), F.col("x.k").alias("k"), F.col("x.m").alias("value"), F.lit(True).alias("seed"))
    others = scan.select(F.explode("unseen").alias("x")).select(_pattern(F.col("x.l")).alias("pattern"), F.explode("x.kinds").alias("k"), F.col("x.m").alias("value"), F.lit(False).alias("seed"))
    return seeds.union(others).where("pattern IS NOT NULL").distinct()


def _scores(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, k, score) of the patterns that may vouch, from what is known.

    ``known``: value and its kind. A pattern's score for a kind is the share of
    that kind among its known values; it needs MIN_SEEDS of them and MIN_SHARE of
    all its values. Values that nothing is known of do not speak against it.
    """
    told = edges.select("pattern", "value").distinct().join(known, "value", "left")
    counts = told.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.count("kind").alias("known"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in range(len(KINDS))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in range(len(KINDS))]))
    rows = counts.select("pattern", "values", "known", each.alias("x")).select("pattern", "x.k", "x.n", "values", (F.col("x.n") / F.col("known")).alias("score"))
    return rows.where((F.col("n") >= MIN_SEEDS) & (F.col("n") >= MIN_SHARE * F.col("values")) & (F.col("score") >= MIN_SCORE)).select("pattern", "k", "score")


def discovered(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(value, k, trust) of the unseen values that trusted patterns vouch for.

    Each round scores the patterns by all that is known, seeds and what earlier
    rounds found alike, so a context that only found values share is learnt in
    its turn. What is found stays, with the trust it had then, so the rounds end:
    with the first that finds nothing new, or after ``rounds``. A value's trust
    is one minus the product of its patterns' doubts.
    """
    others = written(edges.where("NOT seed").select("pattern", "k", "value"), "pii-unseen")
    known = written(edges.where("seed").groupBy("value").agg(F.min("k").alias("kind")).select("*", F.lit(None).cast("double").alias("trust")), "pii-known")
    turn = 0
    while rounds is None or turn < rounds:
        # a written table, so that a pattern with many values can be split over tasks
        trusted = written(_scores(edges, known.select("value", "kind")), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        trust = others.join(trusted, ["pattern", "k"]).groupBy("value", "k").agg((1 - doubt).alias("trust"))
        best = trust.groupBy("value").agg(F.max(F.struct("trust", -F.col("k"))).alias("best"))
        best = best.where(F.col("best.trust") >= MIN_SCORE).select("value", (-F.col("best.col2")).alias("kind"), "best.trust")
        new = written(best.join(known, "value", "left_anti"), "pii-found")
        if new.isEmpty():
            break
        before, known = known, written(known.union(new), "pii-known")
        for done in (before, trusted, new):
            dropped(done)
        turn += 1
    return known.where("trust IS NOT NULL").select("value", F.col("kind").alias("k"), "trust")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of
    struct<k,s,e>, k indexing KINDS, by kind, then start).

    Null and empty texts have no spans; null ids and repeated rows stay as they
    are; very long texts are read whole by patterns that never go back; other
    columns are ignored; an empty table gives an empty result.
    """
    scan = written(scanned(docs), "pii-scan")
    extra = discovered(written(graph(scan), "pii-graph"))
    at = scan.select("doc_id", "text hash", F.explode("unseen").alias("x")).select("doc_id", "text hash", F.col("x.m").alias("value"), "x.s", "x.e")
    # what is found grows with the corpus, so it is never broadcast
    more = at.join(extra.hint("merge"), "value").groupBy("doc_id", "text hash").agg(F.collect_set(F.struct("k", "s", "e")).alias("more"))
    a, b = scan.alias("a"), more.alias("b")
    rows = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text hash") == F.col("b.text hash")), "left")
    base = F.transform("a.base", lambda x: F.struct(x["k"], x["s"], x["e"]))
    return rows.select("a.doc_id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("b.more", F.array().cast("array<struct<k:int,s:int,e:int>>")))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``personal_data`` for comparison."""
    n = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
