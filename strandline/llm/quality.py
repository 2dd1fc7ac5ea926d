"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is a bit, and the
measurements it used stay beside it. A policy is a named, versioned set of
rules, so applying one, comparing versions and asking what a rule costs are
bitwise operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import word_array, written

WINDOW = 3
SYMBOLS = "#*$%&|<>"

#: name -> failure condition on the measurements. The order gives the bits.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "overlong_words": "word_chars > 20 * n_words",
    "shouting": "10 * n_exclaims > 3 * n_words",
}
BASE = ("too_few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbol_heavy", "repeated_lines"),
    "web-2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def _occurrences(text: Column, piece: str) -> Column:
    left = F.length(F.replace(text, F.lit(piece), F.lit("")))
    return ((F.length(text) - left) / len(piece)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of MEASURES, one row per row of ``docs``.

    Null and empty texts measure zero. Other columns are ignored; repeated rows and null ids stay as they are. Repeated windows are
    found per document by sorting (hash, position) pairs, so a very long text
    costs n log n, and only texts that repeat a window pay for the sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text.alias("t")).select("doc_id", "t", word_array(F.col("t")).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _occurrences(F.col("t"), "!!").alias("n_exclaims"),
        lines.alias("lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.slice("words", F.lit(1), F.size("words") - (WINDOW - 1)), lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, WINDOW)])),
        ).alias("hashes"),
    )
    step = step.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "pairs": F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    })
    repeated = F.filter("pairs", lambda e, i: F.coalesce(e["h"] == F.get("pairs", i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("pairs", i + 1)["h"], F.lit(False)))
    step = step.drop("lines", "hashes").withColumn("at", F.array_sort(F.transform(repeated, lambda e: e["p"]))).drop("pairs")
    covers = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(p - F.get("at", i - 1), F.lit(WINDOW))))
    covered = F.aggregate(covers, F.lit(0).cast("long"), lambda total, x: total + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select("doc_id", *MEASURES)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: one bit for each rule failed."""
    bits = [F.when(F.expr(condition), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")) for rule, condition in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def passes(rules: tuple[str, ...]) -> Column:
    """True where a ledger row fails none of ``rules``."""
    return F.col("failed").bitwiseAND(F.lit(mask(rules))) == 0


def ablation(book: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For every policy and rule in it: documents that fail the rule, that fail
    it alone (what dropping the rule would bring back), and those kept.

    The ledger shrinks to one row for each distinct bitmask before anything is
    compared.
    """
    counts = book.groupBy("failed").agg(F.count(F.lit(1)).alias("docs"))
    entries = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"), F.lit(bit(r)).cast("long").alias("bit")) for p, rules in policies.items() for r in rules])
    rows = counts.withColumn("e", F.explode(entries)).select("failed", "docs", "e.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("docs"))), F.lit(0)).cast("long")
    return rows.groupBy("policy", "rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_only_this"),
        count(hit == 0).alias("n_kept"),
    )


def decided(book: DataFrame, policy: str = "web-2") -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy of POLICIES."""
    return book.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(POLICIES[policy])})


def judged(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The ledger of ``docs``, written once, decided by ``policy``."""
    return decided(written(ledger(docs), "quality-ledger"), policy)


def filtered(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """``docs`` without the rows that the policy rejects; all columns stay.

    Each row travels whole beside its measurements, so nothing is joined back
    and columns of any name are safe.
    """
    names = docs.columns
    keyed = docs.select(F.col("text"), F.struct(*names).alias("doc_id"))
    # the row number keeps the filter above the measurements: pushed below them,
    # it would repeat each of them wherever another one uses it
    rows = decided(ledger(keyed), policy).withColumn("row number", F.monotonically_increasing_id())
    return rows.where(F.col("kept") & (F.col("row number") >= 0)).select("doc_id.*")
