"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and reordered.

A batch of texts is one UTF-8 buffer, and one pass of numpy treats all its rows
together: a table gives every byte its class, pairs of neighbouring classes say
where a unit begins, running sums that start anew with every document count the
units, and one sorted search finds all cuts. Draws are hashes of ids, made and
checked on the JVM side, so runs agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.buffers import gathered, occurrences, running, sliced, strings, utf8

MARKS = ("<P>", "<S>", "<M>")
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
#: Bytes of text a kernel treats at once; its arrays take about thirty times that.
SLICE_BYTES = 4 << 20

_OTHER, _NEWLINE, _SPACE, _FOLLOWS = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _NEWLINE
_CLASS[0x80:0xC0] = _FOLLOWS


def _pairs(unit: str) -> np.ndarray:
    """[class before, class here]: whether a unit begins here."""
    table = np.zeros((4, 4), bool)
    if unit == "line":
        table[_NEWLINE, :] = True
    elif unit == "word":
        table[[_NEWLINE, _SPACE], _OTHER] = True
    elif unit == "char":
        table[:, [_OTHER, _NEWLINE, _SPACE]] = True
    else:
        raise ValueError(f"unknown unit: {unit}")
    return table


def cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units per row, byte places of both cuts (rows, 2), and code points of
    prefix and middle. ``draws`` (rows, 2) are reduced by the units plus one."""
    kind = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = _pairs(unit)[kind[:-1], kind[1:]]
    first, last = offsets[:-1], offsets[1:]
    begins[first[last > first]] = True
    units = running(begins)
    n = units[last] - units[first]
    chosen = np.sort(draws % (n + 1)[:, None], axis=1)
    # the unit behind the last one chosen begins where the running sum first passes it
    at = np.searchsorted(units[1:], (units[first][:, None] + chosen + 1).ravel(), "left").reshape(chosen.shape)
    at = np.minimum(at, last[:, None])
    points = running(kind != _FOLLOWS)
    return n, at, points[at[:, 0]] - points[first], points[at[:, 1]] - points[at[:, 0]]


def _kernel(key: str, unit: str, marks: tuple[str, ...], rate: int, spm: int):
    literal = [m.encode() for m in marks]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ("text",), SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            first, last = offsets[:-1], offsets[1:]
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)], axis=1)
            n, at, prefix, middle = cut(data, offsets, h[:, :2], unit)
            marked = np.zeros(len(first), bool)
            for m in literal:
                marked[np.searchsorted(offsets, occurrences(data, offsets, m), "right") - 1] = True
            plain = (last == first) | marked | (h[:, 2] % 100 >= rate)
            form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
            source = np.concatenate([data, np.frombuffer(b"".join(literal), np.uint8)])
            ends = len(data) + np.cumsum([0, *map(len, literal)])
            p, s, m = ((np.full(len(first), ends[k]), np.full(len(first), len(literal[k]))) for k in range(3))
            pre, mid, suf = (first, at[:, 0] - first), (at[:, 0], at[:, 1] - at[:, 0]), (at[:, 1], last - at[:, 1])
            none = (first, np.zeros_like(first))
            orders = ([(first, last - first), *[none] * 5], [p, pre, s, suf, m, mid], [s, suf, p, pre, m, mid])
            starts = np.choose(form[:, None], [np.stack([x[0] for x in o], axis=1) for o in orders])
            lengths = np.choose(form[:, None], [np.stack([x[1] for x in o], axis=1) for o in orders])
            out = gathered(source, starts.ravel(), lengths.ravel())
            places = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n), pa.array(FORMS[form], pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), strings(out, places)],
                [key, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return kernel


def infilled(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Every text of ``docs`` once: ``key``, n (units), form (plain, psm or spm),
    prefix_chars and middle_chars (null if plain), output.

    Units are lines, words with the white space behind them, or code points.
    ``rate`` per cent are cut, of these ``spm`` per cent with the suffix first.
    A null text is empty; empty texts, and those that hold a mark, stay plain.
    A null id draws as an empty one. Rows that repeat have repeated results, no
    rows give none, and other columns of ``docs``, whatever their names, are
    left out. Nothing is shuffled; a long text is one kernel's work and takes
    about thirty times its size in memory."""
    ids, texts = docs[key], docs[text]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    rows = docs.select(ids.alias(key), F.coalesce(texts, F.lit("")).alias("text"), digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(1, 5)]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    return rows.select(key, "text", *draws).mapInArrow(_kernel(key, unit, marks, rate, spm), schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from. A mark begins with the only place
    that may hold its first character, so texts without marks split one way."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    second, third, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, last, third)).when(form == "spm", F.concat(third, last, second)).otherwise(output)


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``infilled`` with hashes of the output and of the text rebuilt from it."""
    return rows.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
