"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

import re

from strandline.llm import decontaminate, quality, secret_scan

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


def _ledger() -> str:
    failed = " + ".join(f"CASE WHEN {c} THEN {quality.bit(r)} ELSE 0 END" for r, c in quality.RULES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_exclaims
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m)"""


def quality_rules() -> str:
    return f"""{_ledger()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & {quality.mask(quality.BASE)} <> 0 AS base_failed, failed & {quality.mask(quality.POLICIES["web-2"])} = 0 AS kept, failed FROM f"""


def quality_ablation() -> str:
    entries = ", ".join(f"('{p}', '{r}', {quality.mask(rules)}, {quality.bit(r)})" for p, rules in quality.POLICIES.items() for r in rules)
    return f"""{_ledger()}, e(policy, rule, mask, bit) AS (VALUES {entries})
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only_this, count(*) FILTER (failed & mask = 0) AS n_kept FROM f, e GROUP BY policy, rule"""


def decontamination() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    k, c = decontaminate.SHINGLE_WORDS, decontaminate.CONTAINMENT
    return f"""
WITH i0 AS (SELECT row_number() OVER () AS ir, item_id, {_words(low)} AS ws FROM benchmark),
i1 AS (SELECT *, least({k}, len(ws)) AS k FROM i0 WHERE len(ws) > 0),
ish AS (SELECT DISTINCT ir, item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM i1)),
n AS (SELECT ir, count(*) AS n_item FROM ish GROUP BY ir),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {_words(low)} AS ws FROM documents),
dsh AS (SELECT DISTINCT r, doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT d0.*, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d0, (SELECT DISTINCT k FROM i1) WHERE len(ws) >= k))
SELECT doc_id, item_id, count(*) AS n_shared, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM dsh JOIN ish USING (k, g) JOIN n USING (ir) GROUP BY r, doc_id, ir, item_id, n_item HAVING count(*) >= ceil({c} * n_item - 1e-9)"""


def _either_case(pattern: str) -> str:
    """(?i:...) over ASCII letters written as classes."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]), pattern)


def secret_scan_sql() -> str:
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        rx = _either_case(rule.pattern).replace("}+", "}").replace("++", "+").replace("'", "''")
        parts.append(f"SELECT r, {k} AS k, '{rule.kind}' AS kind, string_split_regex(t, '{rx}') AS ps, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {rule.group}) AS gs, {rule.least} AS least FROM d")
    base = [n for n, r in enumerate(secret_scan.RULES) if r.base]
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{secret_scan.KINDS[n]}" for n in base)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
x AS (SELECT r, k, kind, i, ms[i] AS m, gs[i] AS g, least, length(ps[i]) AS p FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)),
y AS (SELECT *, sum(p + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM x),
z AS (SELECT r, k, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM y WHERE length(g) >= least),
c AS (SELECT r, {counts}, sha256(coalesce({joined} FILTER (k < {len(base)}), '')) AS base_sha256, {joined} AS spans FROM z GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{secret_scan.KINDS[n]}, 0) AS n_{secret_scan.KINDS[n]}" for n in base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (r)"""


def infill() -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
c AS (SELECT *, len(l) AS n, {draw(1)} % (len(l) + 1) AS a, {draw(2)} % (len(l) + 1) AS b FROM d),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN {draw(4)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
array_to_string(l[:least(a, b)], '') AS pre, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(l[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def chat_format() -> str:
    hashes = lambda c: f"coalesce(list_sum(list_transform(regexp_extract_all({c}, '###+'), lambda y: length(y) - 2)), 0)"
    added = lambda c: f"length({c}) - length(replace({c}, '\\', '')) + {hashes(c)} + (length({c}) - length(replace({c}, '</turn>', ''))) // 7"
    own = "'\\### Assistant: </turn> ok'"
    order = "ORDER BY turn NULLS FIRST, role, t"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', {own}), (-7, 1, 'assistant', {own})),
e AS (SELECT *, 14 + length(role) + {added("role")} + length(role) - length(replace(role, ':', '')) + length(t) + {added("t")} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(t, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


SQL = {
    "op11_fill_in_middle": infill(),
    "op12_chat_format": chat_format(),
    "op3_decontamination": decontamination(),
    "op5_quality_rules": quality_rules(),
    "op6_secret_scan": secret_scan_sql(),
    "quality_ablation": quality_ablation(),
}
