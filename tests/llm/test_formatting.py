"""Infilling, chat formatting and conversation repair against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, infill, queries, repair

DOCS = "doc_id long, text string, source string, n long, form string"
TALK = "conv_id long, turn long, role string, text string"
HARD = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- infilling -------------------------------------------------------------------
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\x0b\x0c\r]+(?=[^ \t\n\x0b\x0c\r]|$)|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", "char": r"[\s\S]"}


def plain_infill(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    n = len(parts)
    hexed = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "\n", "\n\n", "a", "a\n", "no end\nof line", "é\n\U0001f600x\ny", "has <P> inside\nit", "almost <P\n> <\nS> <M", "x<S>", "<M>", "\r\n \t\n", "l\n" * 5_000, "long " * 100_000, "<" * 50 + "\n>" * 50]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_infill(spark, sf_dir, unit):
    odd = spark.createDataFrame([(k % 11 if k != 5 else None, t, "s", 1, "x") for k, t in enumerate(ODD * 3)], DOCS)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.lit(1).alias("n"), F.lit("x").alias("form"))
    docs = odd.union(real)
    got = infill.infilled(docs, unit=unit, rate=80)
    back = got.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    rows = docs.collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:6] for r in back], key=key) == sorted([plain_infill(r["doc_id"], r["text"], unit, rate=80) for r in rows], key=key)
    assert sorted(r["back"] for r in back) == sorted(r["text"] or "" for r in rows)
    assert len({r["form"] for r in back}) == 3


def test_infill_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(r["doc_id"], *plain_infill(r["doc_id"], r["text"])[1:5], sha(plain_infill(r["doc_id"], r["text"])[5]), sha(r["text"] or "")) for r in rows}
    assert {tuple(r) for r in queries.op11_fill_in_middle(spark, sf_dir).collect()} == want


def test_infill_of_nothing(spark):
    assert infill.digest(infill.infilled(spark.createDataFrame([], DOCS))).collect() == []


def test_cuts_reset_at_documents():
    data = np.frombuffer(b"a\nb\nc\n\nd", np.uint8)
    n, at, pre, mid = infill.cut(data, np.array([0, 4, 4, 8]), np.array([[1, 2], [0, 0], [3, 0]]), "line")
    assert n.tolist() == [2, 0, 3] and at.tolist() == [[2, 4], [4, 4], [4, 8]]
    assert pre.tolist() == [2, 0, 0] and mid.tolist() == [2, 0, 4]


# -- chat ----------------------------------------------------------------------
TALKS = [
    (-7, 0, "user", HARD), (-7, 1, "assistant", HARD), (None, 0, "us:er\\", "a\\"), (None, 0, None, None), (3, None, "assistant", "####\\\\</turn>\n</turn>\\"), (3, 0, "assistant", "é\U0001f600" * 5), (3, 0, "assistant", "é\U0001f600" * 5),
    (4, 1, "user", ""), (4, 2, "assistant", ""), (5, 9, "", "\n"), (6, 0, "assistant", "###" * 40_000), (7, 0, "assi:stant", "\\" * 7), (7, 1, "assistant", "\\" * 8 + "</turn>"), *[(8, k, ("user", "assistant")[k % 2], f"turn {k}" * 20) for k in range(300)],
]


def escaped(text, more=""):
    return "".join(("\\" if c == "\\" or c in more or text.startswith(("###", "</turn>"), k) else "") + c for k, c in enumerate(text))


def by_conversation(rows):
    talks = defaultdict(list)
    for r in rows:
        talks[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    return {k: sorted(v) for k, v in talks.items()}


def plain_chat(conv, rows):
    every, loss = "".join(f"{r}\n{t}\n" for _, r, t in rows), "".join(t for _, r, t in rows if r == "assistant")
    return conv, len(rows), sha(every), len(loss), sha(loss), sum(len(f"### {escaped(r, ':')}: {escaped(t)}</turn>\n") for _, r, t in rows)


@pytest.mark.parametrize("most", [64, 5_000, chat.SLICE_BYTES])
def test_chat(spark, sf_dir, most):
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id >= 20")
    talks = real.union(spark.createDataFrame(TALKS, TALK)).withColumns({"loss": F.lit(1), "piece": F.lit("x"), "formatted": F.lit(None).cast("string")})
    want = by_conversation(talks.collect())
    pieces = chat.written(chat.formatted(talks, most=most), "test-chat")
    assert {tuple(r) for r in chat.digest(pieces).collect()} == {plain_chat(k, v) for k, v in want.items()}
    back = defaultdict(list)
    for r in sorted(chat.turns(pieces).collect(), key=lambda r: (r["part"], r["piece"], r["nth"])):
        back[r["conv_id"]].append((r["role"], r["text"]))
    assert back == {k: [x[1:] for x in v] for k, v in want.items()}
    if most == 64:
        assert pieces.where("conv_id = 8").count() > 50


def test_chat_of_nothing(spark):
    assert chat.round_trip(spark.createDataFrame([], TALK)).collect() == []


def test_broken_chat():
    data = np.frombuffer(b"### user: text", np.uint8)
    with pytest.raises(ValueError, match="not a formatted"):
        chat.parsed(data, np.array([0, len(data)]))


# -- repair ----------------------------------------------------------------------
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit) by fixed point over (rows read, state), strings compared whole."""
    n, best = len(rows), {}
    best[n, 0] = best[n, 3] = (0, "")
    for i in range(n, -1, -1):
        for _ in range(4):
            for state in range(4):
                ways = [best[i, state]] if (i, state) in best else []
                moves = [("I", i, STEP[state, x], 5) for x in "ua" if (state, x) in STEP]
                if i < n:
                    initial, fault = rows[i]
                    moves.append(("D", i + 1, state, 2))
                    if fault not in ("blank", "duplicate"):
                        more = 5 if fault == "truncated" else 0
                        moves += [("K", i + 1, STEP[state, initial], more)] if (state, initial) in STEP else []
                        moves += [("R", i + 1, STEP[state, x], 1 + more) for x in "ua" if (state, x) in STEP]
                ways += [(cost + best[j, to][0], letter + best[j, to][1]) for letter, j, to, cost in moves if (j, to) in best]
                if ways:
                    best[i, state] = min(ways)
    return best[0, 0]


def plain_repair(rows, damage):
    talks, out = defaultdict(list), {}
    for r in rows:
        conv, turn, role, text = r["conv_id"], r["turn"], " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        talks[conv] += []
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        talks[conv] += [((turn is not None, turn or 0), "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for conv, lines in talks.items():
        lines.sort(key=lambda x: (x[0], x[1], sha(f"{len(x[1])}:{x[1]}{x[2]}")))
        seen, kinds, faults = set(), [], []
        for _, role, text in lines:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            kinds.append((role[:1], faults[-1]))
        cost, audit = cheapest(kinds)
        state, k, left = 0, 0, []
        for letter in audit:
            want = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
            if letter == "I":
                left.append(f"{FULL[want]}:")
                state = STEP[state, want]
                continue
            role, text = lines[k][1:]
            if letter != "D":
                role, initial = (role, role[:1]) if letter == "K" else (FULL[want], want)
                left.append(f"{role}:{text}")
                state = STEP[state, initial]
            k += 1
        turns = {x[0][1] for x in lines if x[0][0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:], strict=False))
        out[conv] = (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(left)))
    return set(out.values())


BROKEN = [
    (None, None, None, None), (None, 3, "user", "Well."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, "user", "Hi."), (1, 9, "assistant", "cut off"), (2, 0, "robot", "Beep!"), (2, 1, "", "x."), (3, 0, "assistant", " \n\t"),
    (4, 4, "user", "A?"), (4, 4, "assistant", "B."), (4, 4, "assistant", "C."), (5, 0, "system", "S."), (5, 1, "system", "S."), (6, 0, "assistant", "word " * 50_000 + "."),
]


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    rng = np.random.default_rng(5)
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    roles, texts = ["user", "assistant", "system", "tool"], ["Yes.", "No", "", "Maybe? ", "So it is!"]
    random = [(100_000 + c, int(rng.integers(0, 12)), roles[rng.integers(0, 4)], texts[rng.integers(0, 5)]) for c in range(60) for _ in range(rng.integers(1, 14))]
    return real.union(spark.createDataFrame(BROKEN + random, TALK)).withColumns({"gone": F.lit(3), "block": F.lit("x"), "fault": F.lit("y"), "same": F.lit(None).cast("string")}).cache()


@pytest.mark.parametrize(("damage", "most"), [(True, 4096), (True, 1), (False, 3)])
def test_repair(spark, talks, damage, most):
    got = repair.digest(repair.repaired(talks, repair.damaged if damage else repair.undamaged, most_rows=most)).collect()
    assert len(got) == talks.select("conv_id").distinct().count()
    assert {tuple(r) for r in got} == plain_repair(talks.collect(), damage)


def test_repair_of_long_conversations(spark):
    """One conversation over many blocks and tasks, another beside it."""
    rng = np.random.default_rng(2)
    long = [(1, k, ("user", "assistant")[int(rng.integers(0, 2))], f"Line {k % 300}{'.' if rng.integers(0, 3) else ''}") for k in range(2_000)]
    rows = spark.createDataFrame([*long, (2, 0, "user", "Hello.")], TALK)
    solved = repair.repaired(rows, most_rows=50)
    assert solved.where("conv_id = 1").count() >= 40
    got = {r["conv_id"]: tuple(r) for r in repair.digest(solved).collect()}
    assert set(got.values()) == plain_repair(rows.collect(), False)


def test_repair_of_nothing(spark):
    assert repair.digest(repair.repaired(spark.createDataFrame([], TALK), repair.damaged)).collect() == []


def test_bucket_queue():
    """Distances against the fixed point, from every start and for uneven ends."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        rows = [(str(rng.choice(list("suax"))), str(rng.choice(["", "", "blank", "duplicate", "truncated"]))) for _ in range(rng.integers(0, 7))]
        d = repair.distances(rows, repair.GOAL)
        assert (d[0], repair.walk(rows, d, 0, True)[0]) == cheapest(rows)
