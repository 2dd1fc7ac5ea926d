"""Conversations in a chat template, with the loss mask of the replies.

A turn is ``### role: text</turn>`` and a line end. Inside roles and texts a
backslash goes before every backslash and wherever ``###`` or ``</turn>`` begins
(in roles also before colons), so a turn's marks stand nowhere else and reading
gives back what was written, whatever it was.

The rows of a batch are put together as columns of bytes: numpy computes how
long every segment will be, running sums of the lengths say where it goes, and
headers and contents are scattered into one buffer that becomes an Arrow array.
Conversations are runs of the range-partitioned, sorted rows. One that crosses
a partition, or is larger than a piece may be, comes in several pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.buffers import begins, gathered, occurrences, running, sliced, strings, utf8
from strandline.llm.common import written

HEAD, BETWEEN, TURN_END = b"### ", b": ", b"</turn>\n"
CONTROL = (b"\\", b"###", b"</turn>")
#: Bytes of roles and texts that one kernel call puts together, at most (or one turn); also the size at which a conversation goes on in another piece.
SLICE_BYTES = 4 << 20
SLASH, COLON, NEWLINE = 92, 58, 10


def _scattered(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray, before: np.ndarray, at: np.ndarray) -> None:
    """Copies the rows of ``data`` to the places ``at``, each marked byte behind a
    backslash; ``before`` is the running sum of the marks."""
    shift = np.repeat(at - offsets[:-1] - before[offsets[:-1]], np.diff(offsets))
    to = np.arange(len(data)) + shift + before[1:]
    out[to] = data
    out[to[marked] - 1] = SLASH


def _marks(data: np.ndarray, offsets: np.ndarray, control: tuple[bytes, ...]) -> np.ndarray:
    marked = np.zeros(len(data), bool)
    for c in control:
        marked[occurrences(data, offsets, c)] = True
    return marked


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns' bytes, the offsets of the turns, and where in the bytes each
    turn's text begins and ends."""
    parts = []
    for array, control in ((role, (*CONTROL, b":")), (text, CONTROL)):
        data, offsets = utf8(array)
        marked = _marks(data, offsets, control)
        before = running(marked)
        parts.append((data, offsets, marked, before, np.diff(offsets) + np.diff(before[offsets])))
    lengths = np.stack([np.full(len(role), len(HEAD)), parts[0][4], np.full(len(role), len(BETWEEN)), parts[1][4], np.full(len(role), len(TURN_END))], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(role) else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, BETWEEN), (4, TURN_END)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, (data, offsets, marked, before, _) in ((1, parts[0]), (3, parts[1])):
        _scattered(out, data, offsets, marked, before, starts[:, k])
    return out, np.concatenate([[0], ends[:, -1]]), starts[:, 3], ends[:, 3]


def _points(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte."""
    return running((data & 0xC0) != 0x80)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _pieces(table: pa.RecordBatch, part: int, number: int, first: bool, last: bool) -> pa.RecordBatch:
    """One row per conversation of sorted rows. The first of a partition may go
    on from the partition before, the last into the next: those are not whole."""
    conv = table.column("conv_id")
    new = begins(conv)
    heads = np.flatnonzero(new)
    out, turns, begin, end = assembled(table.column("role"), table.column("text"))
    points = _points(out)
    bounds = np.append(heads, len(conv))
    places = turns[bounds]
    loss = table.column("loss").to_numpy(zero_copy_only=False)
    piece = np.cumsum(new) - 1
    base = points[places[:-1]][piece][loss]
    sizes = np.bincount(piece[loss], minlength=len(heads))
    whole = np.ones(len(heads), bool)
    whole[0] &= not first
    whole[-1] &= not last
    return pa.RecordBatch.from_arrays(
        [
            conv.take(pa.array(heads)), pa.array(np.full(len(heads), part)), pa.array(number + np.arange(len(heads))), pa.array(np.diff(bounds)), strings(out, places),
            _lists(points[begin[loss]] - base, sizes), _lists(points[end[loss]] - base, sizes), pa.array(np.diff(points[places])), pa.array(whole),
        ],
        ["conv_id", "part", "piece", "n_turns", "formatted", "loss_start", "loss_end", "n_chars", "whole"],
    )


def _format(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces. The last conversation of a slice waits for its next
    rows while it is small enough."""
    part, number, opened, held = TaskContext.get().partitionId(), 0, True, None
    for batch in sliced(batches, ("role", "text"), most):
        table = batch
        if held is not None:
            if held.nbytes > most:
                pieces = _pieces(held, part, number, opened, held.column("conv_id")[-1].as_py() == batch.column("conv_id")[0].as_py())
                opened = not pieces.column("whole")[-1].as_py()
                number += pieces.num_rows
                yield pieces
            else:
                table = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k = int(np.flatnonzero(begins(table.column("conv_id")))[-1])
        if k:
            pieces = _pieces(table.slice(0, k), part, number, opened, False)
            opened = False
            number += pieces.num_rows
            yield pieces
        held = pa.Table.from_batches([table.slice(k)]).combine_chunks().to_batches()[0]
    if held is not None:
        yield _pieces(held, part, number, opened, True)


def _piece_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("part long, piece long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>, n_chars long, whole boolean").fields])


def formatted(conversations: DataFrame, learn: str = "assistant", most: int = SLICE_BYTES) -> DataFrame:
    """Pieces of formatted conversations: conv_id, part, piece, n_turns,
    formatted, loss_start and loss_end (code points in the piece, end
    exclusive, a pair for each turn of the role ``learn``), n_chars, whole.

    Rows come by turn, nulls first, ties by role and text; a conversation's
    pieces are in order of (part, piece), and ``whole`` says there is only one.
    Null roles and texts are empty, rows without conv_id are one conversation,
    rows that repeat are turns like others, no rows give no pieces, and other
    columns are left out. A conversation of any length is dealt to many tasks by
    its turns; a text of any length is one turn, put together alone."""
    c = conversations
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))
    order = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "role", "text", (F.col("role") == learn).alias("loss")).mapInArrow(lambda batches: _format(batches, most), _piece_schema(rows.schema["conv_id"].dataType))


def parsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reads pieces: (bytes to keep, bytes with the turns' marks as line ends,
    turn starts, text starts, text ends). Every first byte of a pair in a run of
    backslashes goes, and what follows it is no mark."""
    slash = np.flatnonzero(data == SLASH)
    new = np.ones(len(slash), bool)
    new[1:] = np.diff(slash) != 1
    new |= np.isin(slash, offsets)
    heads = np.flatnonzero(new)
    nth = np.arange(len(slash)) - np.repeat(heads, np.diff(np.append(heads, len(slash))))
    escapers = slash[nth % 2 == 0]
    literal = np.zeros(len(data) + 1, bool)
    literal[escapers + 1] = True
    ends = occurrences(data, offsets, TURN_END)
    ends = ends[~literal[ends]]
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], ends + len(TURN_END))
    starts = starts[starts < len(data)]
    colons = np.flatnonzero(data == COLON)
    colons = colons[~literal[colons]]
    colon = colons[np.searchsorted(colons, starts + len(HEAD))] if len(starts) else starts
    if len(starts) != len(ends) or not (data[starts[:, None] + np.arange(len(HEAD))] == np.frombuffer(HEAD, np.uint8)).all():
        raise ValueError("not a formatted conversation")
    keep = np.ones(len(data), bool)
    keep[escapers] = False
    keep[(starts[:, None] + np.arange(len(HEAD))).ravel()] = False
    keep[colon + 1] = False
    keep[(ends[:, None] + np.arange(len(TURN_END) - 1)).ravel()] = False
    lines = data.copy()
    lines[colon] = NEWLINE
    return keep, lines, starts, colon + len(BETWEEN), ends


class _Sums:
    """What is told of one conversation while its pieces pass by."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)

        for batch in sliced(batches, ("formatted",), 2 * SLICE_BYTES):
            data, offsets = utf8(batch.column("formatted"))
            keep, lines, starts, _, _ = parsed(data, offsets)
            points = _points(data)
            # the mask's code points as bytes: where the running count first passes them
            piece = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("loss_start").offsets.to_numpy()))
            mask = np.zeros(len(data) + 1, np.int64)
            for name, step in (("loss_start", 1), ("loss_end", -1)):
                at = batch.column(name).flatten().to_numpy() + points[offsets[piece]]
                np.add.at(mask, np.searchsorted(points[1:], at + 1, "left"), step)
            learnt = np.cumsum(mask[:-1]).astype(bool) & keep
            kept, learnt_to, turns = running(keep)[offsets], running(learnt)[offsets], np.searchsorted(starts, offsets)
            every, loss = lines[keep], data[learnt]
            loss_points = _points(loss)
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Sums(conv)
                now.turns += int(turns[k + 1] - turns[k])
                now.chars += int(points[offsets[k + 1]] - points[offsets[k]])
                now.all.update(every[kept[k] : kept[k + 1]])
                now.loss.update(loss[learnt_to[k] : learnt_to[k + 1]])
                now.loss_chars += int(loss_points[learnt_to[k + 1]] - loss_points[learnt_to[k]])
            if len(done) >= 1_000:
                yield rows()
                done.clear()
        if now is not None:
            done.append(now.row())
            yield rows()

    return read


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation, read from its pieces: conv_id, n_turns, turns_sha256 (of
    role, line end, text, line end), loss_chars, loss_sha256 (of the text under
    the mask), formatted_chars. Whole conversations are read where they lie;
    only those in several pieces are brought together, and stream through their
    task a piece at a time, as their hashes run over all their bytes in order."""
    kind = pieces.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    names = ["conv_id", "formatted", "loss_start", "loss_end"]
    read = _read(pa.schema([("conv_id", pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    parts = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return pieces.where("whole").select(*names).mapInArrow(read, schema).union(parts.select(*names).mapInArrow(read, schema))


def turns(pieces: DataFrame) -> DataFrame:
    """The rows that the pieces were made from, nulls as empty texts: conv_id,
    part, piece, nth (of the piece, from 0), role, text."""
    kind = pieces.schema["conv_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ("formatted",), 2 * SLICE_BYTES):
            data, offsets = utf8(batch.column("formatted"))
            keep, lines, starts, texts, ends = parsed(data, offsets)
            every, to = lines[keep], running(keep)
            columns = []
            for a, b in ((to[starts], to[texts] - 1), (to[texts], to[ends])):
                columns.append(strings(gathered(every, a, b - a), np.concatenate([[0], np.cumsum(b - a)])))
            piece = np.searchsorted(offsets, starts, "right") - 1
            nth = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[piece]
            names = ("conv_id", "part", "piece")
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(piece)) for c in names], pa.array(nth), *columns], [*names, "nth", "role", "text"])

    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("part long, piece long, nth long, role string, text string").fields])
    return pieces.select("conv_id", "part", "piece", "formatted").mapInArrow(read, schema)


def round_trip(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """Formats, writes the pieces, and tells what is read back from them."""
    return digest(written(formatted(conversations, learn), "chat"))
