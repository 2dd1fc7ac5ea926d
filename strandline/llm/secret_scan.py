"""Secret scanning through a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams that any match
must contain. The index holds postings (trigram, document) for the trigrams the
rules ask for; intersecting a query's postings gives the documents worth
verifying with that rule. A rule without mandatory trigrams scans everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written
from strandline.llm.spans import matches


@dataclass(frozen=True)
class Rule:
    """``least``: characters that the match, or its group, has to have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Base rules first, in the order of the digest; then the added ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]++", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}+", 0, 24, True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}+"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}+"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"),
)
KINDS = tuple(r.kind for r in RULES)
_MOST_STRINGS = 64
_MOST_CHARS = 8
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)

#: A query in disjunctive pieces: every inner set's trigrams must all be there,
#: for one set at least of each group; no groups: no mandatory trigrams.
Query = tuple[frozenset[frozenset[str]], ...]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _chars(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None if there are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < _MOST_CHARS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= _MOST_CHARS else None


def _strings(seq) -> set[str] | None:
    """All lower-cased strings a part of a pattern can match, if they are few."""
    found = {""}
    for op, arg in seq:
        if op is C.LITERAL:
            each = {chr(arg).lower()}
        elif op is C.IN:
            each = _chars(arg)
        elif op is C.SUBPATTERN:
            each = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            each = None if None in parts else set().union(*parts)
        elif op in _REPEATS and arg[1] != C.MAXREPEAT and arg[1] <= 4:
            one = _strings(arg[2])
            each = None if one is None else {s for n in range(arg[0], arg[1] + 1) for s in _power(one, n)}
        else:
            each = None
        if each is None or len(found) * len(each) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in each}
    return found


def _power(one: set[str], n: int) -> set[str]:
    found = {""}
    for _ in range(n):
        found = {a + b for a in found for b in one}
        if len(found) > _MOST_STRINGS:
            return found
    return found


def query(pattern: str) -> Query:
    """The trigram query of a pattern. The index is lower-cased, so the query is
    too. Neighbouring parts with few strings are read as one."""
    groups, now = [], {""}

    def close() -> None:
        nonlocal now
        if all(len(s) >= 3 for s in now):
            groups.append(frozenset(trigrams(s) for s in now))
        now = {""}

    for item in parser.parse(pattern):
        some = _strings([item])
        if some is not None and len(now) * len(some) <= _MOST_STRINGS:
            now = {a + b for a in now for b in some}
            continue
        close()
        if some is not None:
            now = some
    close()
    return tuple(groups)


QUERIES = {r.kind: query(r.pattern) for r in RULES}
NEEDED = sorted({t for q in QUERIES.values() for group in q for grams in group for t in grams})


def postings(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id, text hash) for every needed trigram of every text."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text hash"), low.alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(NEEDED)]))
    return rows.select("doc_id", "text hash", F.explode(held).alias("trigram"))


def _words_of(ids: list[int]) -> list[int]:
    """Bit masks of trigram numbers, 62 bits to a word."""
    return [sum(1 << (i % 62) for i in ids if i // 62 == w) for w in range(-(-len(NEEDED) // 62))]


def candidates(index: DataFrame) -> DataFrame:
    """doc_id, text hash and ``rules``: the bits of the rules whose query the
    document's postings satisfy. Intersection is one grouped OR: each document's
    postings become a bitmap, and a query is a test of bits."""
    n = -(-len(NEEDED) // 62)
    bit = F.expr("shiftleft(1L, trigram % 62)")
    maps = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(n)]
    grouped = index.groupBy("doc_id", "text hash").agg(*maps)

    def holds(grams: frozenset[str]) -> Column:
        tests = [F.col(f"w{w}").bitwiseAND(F.lit(m)) == m for w, m in enumerate(_words_of([NEEDED.index(t) for t in grams])) if m]
        return reduce(lambda a, b: a & b, tests)

    bits = F.lit(0)
    for k, rule in enumerate(RULES):
        if q := QUERIES[rule.kind]:
            all_groups = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [holds(g) for g in sorted(group, key=sorted)]) for group in q])
            bits = bits + F.when(all_groups, F.lit(1 << k)).otherwise(F.lit(0))
    return grouped.select("doc_id", "text hash", bits.alias("rules")).where("rules <> 0")


def _rule_spans(text: Column, rules: Column, k: int) -> Column:
    rule = RULES[k]
    found = F.filter(matches(text, rule.pattern, rule.group), lambda x: F.length(x["g"]) >= rule.least)
    spans = F.transform(found, lambda x: F.struct(x["s"], F.lit(k).alias("k"), x["e"])).cast("array<struct<s:int,k:int,e:int>>")
    if not QUERIES[rule.kind]:
        return spans
    return F.when(rules.bitwiseAND(F.lit(1 << k)) != 0, spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of
    struct<s,k,e> by start, then rule; k indexes RULES.

    Null and empty texts have none; null ids and repeated rows stay as they are;
    other columns are ignored; an empty table gives an empty result.
    """
    index = written(postings(docs), "secret-postings")
    found = candidates(index).withColumnsRenamed({"doc_id": "id", "text hash": "hash"})
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = rows.withColumn("text hash", F.xxhash64("t"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text hash") == F.col("hash")), "left")
    both = both.select("doc_id", "t", F.coalesce("rules", F.lit(0)).alias("rules"))
    spans = F.array_sort(F.concat(*[_rule_spans(F.col("t"), F.col("rules"), k) for k in range(len(RULES))]))
    return both.select("doc_id", spans.alias("spans"))


def _of_rule(k: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``secrets`` for comparison."""
    base = [k for k, r in enumerate(RULES) if r.base]
    only = F.filter("spans", lambda x: x["k"] < len(base))
    return found.select("doc_id", *[_of_rule(k).alias(f"n_{KINDS[k]}") for k in base], F.sha2(_joined(only), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def verified(text: str, kind: str) -> bool:
    """Plain check of one rule on one text, for tests."""
    rule = next(r for r in RULES if r.kind == kind)
    return any(len(m[rule.group]) >= rule.least for m in re.finditer(rule.pattern, text))
