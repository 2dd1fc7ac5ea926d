"""Cheapest repair of conversations: which rows to keep, rerole, delete or insert.

A conversation is fine when its role initials read ``(s?(ua)+)?``. The graph of
a conversation has a node for every number of rows read and every state of that
pattern; edits are its arcs, with integer costs of at most six. Distances to the
end come from Dial's bucket queue, and the audit is a walk along tight arcs that
takes the least letter at every node.

Spark sorts the rows, cuts conversations into blocks of bounded size, and solves
blocks side by side. A conversation of one block, nearly every one, is solved
where it lies. For the others each block gives a 4 x 4 matrix of distances, then
the last state for each first state; only these small rows pass through one task
per conversation, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAR = 1 << 60
#: Rows, and characters of their roles and texts, in one block at most (or one row).
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
GOAL = (0, FAR, FAR, 0)
#: States: nothing yet, after s, after u, after a. What to reach, and the role to be in to get there.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_BY_INITIAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


# -- one block ------------------------------------------------------------------
def arcs(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, by letter."""
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = CUT if fault == "truncated" else 0
        if (to := _BY_INITIAL[state].get(initial)) is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


_ARRIVING: dict[tuple[str, str], tuple] = {}


def _arriving(initial: str, fault: str) -> tuple[tuple[tuple[int, int], ...], ...]:
    """By state after a row of this kind: (state before it, cost)."""
    kind = (initial if initial in "sua" else "", fault)
    if kind not in _ARRIVING:
        into = ([], [], [], [])
        for state in range(4):
            for _, cost, to in arcs(*kind, state):
                into[to].append((state, cost))
        _ARRIVING[kind] = tuple(map(tuple, into))
    return _ARRIVING[kind]


_INSERTING = ((), (), (0, 1, 3), (2,))


def distances(rows: list[tuple[str, str]], ends: Iterable[int]) -> list[int]:
    """Least cost from every node (4 * rows read + state) to the end, where the
    four nodes behind the last row start from ``ends``. Dial's queue: a bucket of
    nodes for every distance, in order; costs are small, so few are empty."""
    n = len(rows)
    d = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = []
    low = min(ends)

    def put(node: int, cost: int) -> None:
        if cost < d[node]:
            d[node] = cost
            while len(buckets) <= cost - low:
                buckets.append([])
            buckets[cost - low].append(node)

    for state, cost in enumerate(ends):
        if cost < FAR:
            put(4 * n + state, cost)
    into = [_arriving(*r) for r in rows]
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # grows by arcs of cost 0
            cost = at + low
            if d[node] < cost:
                continue
            read, state = divmod(node, 4)
            for before in _INSERTING[state]:
                put(4 * read + before, cost + INSERT)
            if read:
                for before, more in into[read - 1][state]:
                    put(4 * read - 4 + before, cost + more)
        buckets[at] = []
        at += 1
    return d


def walk(rows: list[tuple[str, str]], d: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least letters of a cheapest way from ``state``, and the state it
    ends in. The last block goes on to the goal, others stop behind their rows."""
    letters, i, n = [], 0, len(rows)
    while i < n or last and d[4 * i + state]:
        here = d[4 * i + state]
        options = [("I", 4 * i + _NEXT[state], INSERT)]
        if i < n:
            options += [(letter, 4 * i + 4 + to, cost) for letter, cost, to in arcs(*rows[i], state)]
        letter, node = min((letter, node) for letter, node, cost in options if d[node] + cost == here)
        letters.append(letter)
        i, state = divmod(node, 4)
    return "".join(letters), state


def edited(rows: list[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, int, str]]:
    """(letter, row or -1, role from the repair or empty) for every edit."""
    i = 0
    for letter in letters:
        if letter == "I":
            yield letter, -1, _ROLE[state]
            state = _NEXT[state]
            continue
        yield letter, i, _ROLE[state] if letter == "R" else ""
        state = {"D": state, "R": _NEXT[state]}.get(letter, _BY_INITIAL[state].get(rows[i][0], state))
        i += 1


# -- rows and their faults ------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after damage by a hash of their
    place: nulls are one space; 0 drops a row (kept as ``gone``, so that its
    conversation is known), 1 empties the text, 2 removes its full stops, 3
    repeats the row, 4 makes it the user's."""
    c = conversations
    named = c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), F.coalesce(c["role"], F.lit(" ")).alias("role"), F.coalesce(c["text"], F.lit(" ")).alias("text"))
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = named.withColumn("how", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat("how", F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns with nothing damaged."""
    c = conversations
    return c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), F.coalesce(c["role"], F.lit(" ")).alias("role"), F.coalesce(c["text"], F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def faulty(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: blank, truncated, or what may be a duplicate (``again`` if
    role and text come in an earlier turn; a repeat within the turn is seen when
    the rows are in order). First turns are counted before they meet the rows."""
    marked = rows.withColumn("same", F.when(~F.col("gone"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    known = marked.where("NOT gone").groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
    rows = marked.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    earlier = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("least")))
    tail = _trimmed(F.col("text"))
    fault = F.when(tail == "", "blank").when(earlier, "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "same", "gone", fault.alias("fault"))


# -- blocks ---------------------------------------------------------------------
_BLOCK = """part long, block long, whole boolean, role array<string>, text array<string>, fault array<string>, low long, high long, turns long, first_turn long,
blank long, duplicate long, truncated long, illegal long"""


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())


def _block_fields(kind: T.DataType) -> list[tuple[str, pa.DataType]]:
    texts, n = pa.list_(pa.string()), pa.int64()
    return [("conv_id", _arrow(kind)), ("part", n), ("block", n), ("whole", pa.bool_()), *[(c, texts) for c in ("role", "text", "fault")], *[(c, n) for c in ("low", "high", "turns", "first_turn", "blank", "duplicate", "truncated", "illegal")]]


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


class _Block:
    """Rows of one conversation that lie together, and what is counted of them."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened, self.chars = conv, opened, 0
        self.role, self.text, self.fault, self.turns = [], [], [], []

    def row(self, part: int, number: int, closed: bool) -> dict:
        seen = [t for t in self.turns if t is not None]
        counts = {f: self.fault.count(f) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(not _legal(a, b) for a, b in zip(self.role, self.role[1:], strict=False))
        return {
            "conv_id": self.conv, "part": part, "block": number, "whole": closed and not self.opened, "role": self.role, "text": self.text, "fault": self.fault,
            "low": min(seen, default=None), "high": max(seen, default=None), "turns": len(set(seen)), "first_turn": seen[0] if seen else None, **counts, "illegal": illegal,
        }


def _blocks(schema: pa.Schema, most_rows: int, most_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, before, done, size = TaskContext.get().partitionId(), 0, None, None, [], 0
        for batch in batches:
            for conv, turn, role, text, same, gone, fault in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if now is None or conv != now.conv or len(now.role) >= most_rows or now.chars >= most_chars:
                    if now is not None:
                        done.append(now.row(part, number, conv != now.conv))
                        size += now.chars
                        number += 1
                    # the first of a partition may go on from the one before
                    now = _Block(conv, now is None or conv == now.conv)
                    if len(done) >= 1_000 or size >= BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                if gone:
                    continue
                key = (conv, turn, same)
                if fault != "blank" and key == before:
                    fault = "duplicate"
                before = key
                now.role.append(role)
                now.text.append(text)
                now.fault.append(fault)
                now.turns.append(turn)
                now.chars += len(role) + len(text)
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.row(part, number, False)], schema)

    return cut


def blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """Sorted rows as blocks, in order of (part, block) in each conversation;
    ``whole`` if the conversation has no other. Rows come by turn (nulls first),
    ties by role and a hash of the text, so rows alike stand together."""
    kind = rows.schema["conv_id"].dataType
    key = ["conv_id", "turn", "role", "same"]
    order = faulty(rows).repartitionByRange(*key).sortWithinPartitions(*key)
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(_BLOCK).fields])
    return order.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "same", "gone", "fault").mapInArrow(_blocks(pa.schema(_block_fields(kind)), most_rows, most_chars), schema)


def _kinds(block: dict) -> list[tuple[str, str]]:
    return [(r[:1], f) for r, f in zip(block["role"], block["fault"], strict=True)]


def _each(frame: DataFrame, names: list[str], make, more: str) -> DataFrame:
    """``make`` of every row of ``frame`` (a dict of ``names``): yields dicts of
    the keys and of the columns ``more``."""
    keys = [c for c in ("conv_id", "part", "block") if c in names]
    out = T.StructType([*[frame.schema[c] for c in keys], *T.StructType.fromDDL(more).fields])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(f.name, _arrow(f.dataType) if f.name == "conv_id" else kinds[f.dataType.simpleString()]) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = make()
        done, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in names}
                for made in carried(row):
                    done.append({c: row[c] for c in keys} | made)
                    size += sum(len(v) for v in made.values() if isinstance(v, str)) + sum(sum(map(len, v)) for v in made.values() if isinstance(v, list) and v and isinstance(v[0], str))
                if len(done) >= 1_000 or size >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, fields)
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, fields)

    return frame.select(*names).mapInArrow(run, out)


def _in_order(frame: DataFrame, backwards: bool = False) -> DataFrame:
    order = [F.col(c).desc() if backwards else F.col(c) for c in ("part", "block")]
    return frame.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _matrix():
    def one(b: dict) -> Iterator[dict]:
        kinds = _kinds(b)
        yield {"m": [x for end in range(4) for x in distances(kinds, [0 if s == end else FAR for s in range(4)])[:4]]}

    return one


def _carry_back():
    state = {"conv": (), "v": GOAL}

    def one(b: dict) -> Iterator[dict]:
        last = state["conv"] != (b["conv_id"],)
        v = GOAL if last else state["v"]
        yield {"ends": list(v), "last": last}
        state["conv"] = (b["conv_id"],)
        state["v"] = tuple(min(FAR, *(b["m"][4 * end + s] + v[end] for end in range(4))) for s in range(4))

    return one


def _exits():
    def one(b: dict) -> Iterator[dict]:
        kinds = _kinds(b)
        d = distances(kinds, b["ends"])
        yield {"exits": [walk(kinds, d, s, b["last"])[1] if d[s] < FAR else 0 for s in range(4)]}

    return one


def _carry_on():
    state = {"conv": (), "s": 0}

    def one(b: dict) -> Iterator[dict]:
        s = state["s"] if state["conv"] == (b["conv_id"],) else 0
        yield {"state": s}
        state["conv"], state["s"] = (b["conv_id"],), b["exits"][s]

    return one


_SOLVED = "cost long, audit string, edit array<string>, new_role array<string>, new_text array<string>"


def _solve():
    def one(b: dict) -> Iterator[dict]:
        kinds, s = _kinds(b), b["state"]
        d = distances(kinds, b["ends"])
        letters, end = walk(kinds, d, s, b["last"])
        roles, texts = [], []
        for letter, row, role in edited(kinds, letters, s):
            if letter != "D":
                roles.append(role or b["role"][row])
                texts.append("" if row < 0 else b["text"][row])
        yield {"cost": d[s] - (0 if b["last"] else b["ends"][end]), "audit": letters, "edit": list(letters), "new_role": roles, "new_text": texts}

    return one


def repaired(conversations: DataFrame, prepared=undamaged, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """Solved blocks: conv_id, part, block, the block's counts, cost, audit (the
    block's edits), edit, new_role and new_text (what the repair leaves, in
    order). ``prepared`` makes rows of the table, by default without damage.

    Nulls in role and text are one space; rows without conv_id are one
    conversation; a conversation without rows has an empty block. Other columns
    are left out, no rows give no blocks, a row of any length is a block at
    most. Conversations of several blocks are written once and solved in
    parallel, all but the carried states, which are a few numbers a block."""
    cut = written(blocks(prepared(conversations), most_rows, most_chars), "blocks")
    key = ["conv_id", "part", "block"]
    texts = [*key, "role", "text", "fault"]
    one = cut.where("whole").withColumns({"ends": F.lit(list(GOAL)), "last": F.lit(True), "state": F.lit(0).cast("long")})
    several = cut.where("NOT whole")
    back = written(_each(_in_order(_each(several, [*key, "role", "fault"], _matrix, "m array<bigint>"), True), [*key, "m"], _carry_back, "ends array<bigint>, last boolean"), "ends")
    same = lambda a, b: a.join(b.withColumnRenamed("conv_id", "c"), [F.col("conv_id").eqNullSafe(F.col("c")), a["part"] == b["part"], a["block"] == b["block"]]).drop("c", b["part"], b["block"])
    several = same(several, back)
    on = written(_each(_in_order(_each(several, [*key, "role", "fault", "ends", "last"], _exits, "exits array<bigint>")), [*key, "exits"], _carry_on, "state long"), "states")
    every = one.unionByName(same(several, on).select(*one.columns))
    counts = ["low", "high", "turns", "first_turn", "blank", "duplicate", "truncated", "illegal"]

    def solve():
        make = _solve()

        def run(b: dict) -> Iterator[dict]:
            for made in make(b):
                yield {c: b[c] for c in ("whole", *counts)} | {"rows": len(b["role"]), "first_role": b["role"][0] if b["role"] else None, "last_role": b["role"][-1] if b["role"] else None} | made

        return run

    more = "whole boolean, " + ", ".join(f"{c} long" for c in counts) + ", rows long, first_role string, last_role string, " + _SOLVED
    return _each(every, [*texts, "whole", "ends", "last", "state", *counts], solve, more)


class _Told:
    """A conversation's figures while its blocks pass by."""

    def __init__(self, conv):
        self.conv, self.low, self.high, self.turns, self.role, self.any = conv, None, None, 0, None, False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.hash = [], hashlib.sha256()

    def add(self, b: dict) -> None:
        if b["low"] is not None:
            # rows are sorted, so only the turn at the border can be in both blocks
            self.turns += b["turns"] - (self.high is not None and self.high == b["first_turn"])
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]
        if b["rows"]:
            self.sums["illegal"] += self.role is not None and not _legal(self.role, b["first_role"])
            self.role = b["last_role"]
        for c in self.sums:
            self.sums[c] += b[c]
        self.audit.append(b["audit"])
        for role, text in zip(b["new_role"], b["new_text"], strict=True):
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def digest(solved: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. Whole ones are told where they lie; blocks of
    the others stream through one task each, as one hash runs over all of them
    (what is kept of a conversation is its audit)."""
    kind = solved.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    fields = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                b = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if now is None or now.conv != b["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Told(b["conv_id"])
                now.add(b)
                if len(done) >= 1_000:
                    yield pa.RecordBatch.from_pylist(done, fields)
                    done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.row()], fields)

    return solved.where("whole").mapInArrow(tell, out).union(_in_order(solved.where("NOT whole")).mapInArrow(tell, out))
