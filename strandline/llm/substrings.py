"""Repeated passages: paragraph MinHash banding.

Two kinds of paragraphs are cut from every text. Lines of LEAST_WORDS words or
more are natural paragraphs (a text of fewer words is one paragraph). Passages
are cut by content: of every REACH neighbouring windows of LEAST_WORDS words the
one with the least hash is taken (winnowing), so 50 words that repeat anywhere,
inside lines or across them, are sure to give both places a paragraph in common.

Lines get MinHash signatures over five-word shingles, cut in bands tuned for
recall at a similarity of 0.8; distinct lines that collide are verified by exact
Jaccard (``links.similar_links``), and components over the verified links join
them. Passages of one content are one class by construction. In each class or
component the first place stays, the others are what to remove.

Between two taken windows, what lies there is one more paragraph (a bridge), so
a passage is whole where its bridges repeat as well. Only at its open ends are
windows compared one by one, which grows it to where the texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import dropped, written
from strandline.llm.links import similar_links
from strandline.llm.shingles import Words, mixed

SHINGLE_WORDS = 5
LEAST_WORDS = 25
REACH = 26
#: 5 bands of 2 rows find a pair of similarity 0.8 with 1 - 0.36^5 = 99.4 %,
#: and one of 0.9 with 99.98 %.
BANDS, ROWS = 5, 2
_MULTIPLY = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(101, 357, dtype=np.uint64))
_SLAB = 1 << 14
_WHERE = ["doc_id", "text_hash"]


def winnowed(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places of the least hash (the last, if equal) of every ``reach`` windows;
    of fewer windows, the least of all."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= reach:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    # least hash and its last place of windows of 1, 2, 4 ... places, then of two that overlap
    least, place, size = hashes, np.arange(len(hashes)), 1
    while size < reach:
        step = min(size, reach - size)
        later = least[step:] <= least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        size += step
    return place[np.append(True, place[1:] != place[:-1])]


def _hashed(shingles: np.ndarray, n: int, spare: int = 0) -> np.ndarray:
    """``n`` unrelated hashes of the shingles, each in a row of its own, which ends
    in ``spare`` zeros."""
    rows = np.zeros((n, len(shingles) + spare), np.uint64)
    own = rows[:, : len(shingles)]
    np.multiply(shingles, _MULTIPLY[:n, None], out=own)
    own += _ADD[:n, None]
    own ^= own >> np.uint64(29)
    return rows


def _keys(least: np.ndarray, size: int = ROWS) -> np.ndarray:
    """The band keys of signatures, a row each; a band has ``size`` hashes."""
    n = least.shape[1] // size
    rows = mixed(least).reshape(-1, n, size)
    keys = np.arange(n, dtype=np.uint64)
    for r in range(size):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys.view(np.int64)


def bands(shingles: np.ndarray, n: int = BANDS, size: int = ROWS) -> np.ndarray:
    """The ``n`` band keys, of ``size`` hashes each, of a set of shingle hashes."""
    least = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLAB):
        least = np.minimum(least, _hashed(shingles[at : at + _SLAB], n * size).min(axis=1))
    return _keys(least[None], size)[0]


def bands_of_lines(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The band keys of the lines whose shingles are ``first`` to ``end``, in one
    go; the lines of a very long text one by one."""
    if len(shingles) > 8 * _SLAB:
        return np.concatenate([bands(shingles[i:j]) for i, j in zip(first.tolist(), end.tolist(), strict=True)])
    edges = np.empty(2 * len(first), np.int64)
    edges[::2], edges[1::2] = first, end
    return _keys(np.minimum.reduceat(_hashed(shingles, BANDS * ROWS, 1), edges, axis=1)[:, ::2].T.copy()).ravel()


def shingles_of(words: Words) -> np.ndarray:
    """Distinct hashes of the five-word shingles; fewer words are one shingle."""
    return np.unique(words.windows(min(SHINGLE_WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start and end, in code points, as one long."""
    return (start.astype(np.int64) << 32) | end.astype(np.int64)


def lines_of(words: Words, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """First and last-but-one word of the lines of ``least`` words or more; a
    text of fewer words is one."""
    if 0 < len(words) < least:
        return [(0, len(words))]
    breaks = np.flatnonzero(np.frombuffer(words.data, np.uint8) == 10)
    edges = np.concatenate([[0], np.searchsorted(words.starts, breaks), [len(words)]])
    size = edges[1:] - edges[:-1]
    long = np.flatnonzero(size >= least)
    return list(zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True))


def paragraphs_of(text: str | None, least: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Of a text: places, hashes and bridges of its taken windows; places, two
    hashes and band keys (BANDS to a line) of its lines."""
    words = Words(text)
    none = np.zeros(0, np.int64)
    if not len(words):
        return (none,) * 7
    at = words.code_points()
    begin, end = at[words.starts], at[words.ends]
    one = words.windows(least)
    taken = winnowed(one)
    stop = taken + least
    i, j = np.array(lines_of(words, least), np.int64).reshape(-1, 2).T
    passages = max(0, len(taken) - 1)
    both = [words.spans(np.concatenate([taken[:-1], i]), np.concatenate([stop[1:], j])), words.spans(i, j, 1)] if len(i) or passages else [none.view(np.uint64)] * 2
    bridge = np.append(both[0][:passages], np.zeros(min(1, len(taken)), np.uint64))
    if not len(i):
        keys = none
    elif len(words) < SHINGLE_WORDS:
        keys = bands(shingles_of(words))
    else:
        keys = bands_of_lines(words.windows(SHINGLE_WORDS), i, np.maximum(j - SHINGLE_WORDS + 1, i + 1))
    return (
        _packed(begin[taken], end[stop - 1]), one[taken].view(np.int64), bridge.view(np.int64),
        _packed(begin[i], end[j - 1]), both[0][passages:].view(np.int64), both[1].view(np.int64), keys,
    )


def _located(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the arrays of ``paragraphs_of`` for every row."""
    names = ["places", "hashes", "bridges", "line places", "line h1", "line h2", "line bands"]
    long = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), *(T.StructField(n, long) for n in names)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                made = zip(*[paragraphs_of(t.as_py()) for t in part.column(2)], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[_lists(c) for c in made]], schema.names)

    return _located(docs).mapInArrow(apply, schema)


def _lists(rows: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), pa.int64()))


def _first(*by: str) -> Column:
    """The first place of a class: doc_id (null last), the text's hash, place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), *by)).alias("first")


def _is_first() -> Column:
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return same & (F.col("place") == F.col("first.place"))


def _repeating(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the classes with two places or more, with ``n``, the places, and
    ``goes``: not the first."""
    classes = rows.groupBy(*key).agg(_first("doc_id", "text_hash", "place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = written(classes, "para-firsts")  # so that a passage of many places can be split over tasks
    return rows.join(classes, key).withColumn("goes", ~_is_first()).drop("first")


def near_texts(need: DataFrame, docs: DataFrame) -> DataFrame:
    """One pass over the texts that something is wanted of.

    ``need``: doc_id, text_hash, ``open`` (places of repeated windows, each times
    4, plus 1 if its left end is open and 2 if its right end is) and ``lines``
    (array of struct<key,place>). Rows: doc_id, text_hash, place, h1, h2 of the
    windows at open ends, at most REACH - 1 from a repeated one; or key and
    ``set`` (five-word shingles) of a line.
    """
    d = _located(docs).withColumnsRenamed({"doc_id": "d id", "text_hash": "d hash"})
    near = need.join(d, F.col("doc_id").eqNullSafe(F.col("d id")) & (F.col("text_hash") == F.col("d hash")))
    long = T.LongType()
    schema = T.StructType([
        need.schema["doc_id"], T.StructField("text_hash", long), T.StructField("place", long), T.StructField("h1", long), T.StructField("h2", long),
        T.StructField("key", long), T.StructField("set", T.ArrayType(long)),
    ])

    def windows(words: Words, at: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(words) - LEAST_WORDS + 1
        begin, end = at[words.starts], at[words.ends]
        place, flags = np.searchsorted(begin, anchors >> 2), anchors & 3
        turn = np.zeros(n + 1, np.int64)
        left, right = place[(flags & 1) > 0], place[(flags & 2) > 0]
        np.add.at(turn, np.maximum(left - (REACH - 1), 0), 1)
        np.add.at(turn, left, -1)
        np.add.at(turn, right + 1, 1)
        np.add.at(turn, np.minimum(right + REACH, n), -1)
        taken = np.flatnonzero(np.cumsum(turn[:n]))
        h = [words.spans(taken, taken + LEAST_WORDS, salt).view(np.int64) for salt in (0, 1)]
        return _packed(begin[taken], end[taken + LEAST_WORDS - 1]), *h

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = Words(batch.column(2)[i].as_py())
                at = words.code_points()
                anchors, lines = batch.column(3)[i].values, batch.column(4)[i].as_py() or ()
                here = [batch.column(k).slice(i, 1) for k in (0, 1)]
                if anchors is not None and len(anchors) and len(words) >= LEAST_WORDS:
                    made = windows(words, at, anchors.to_numpy())
                    n = len(made[0])
                    ids = [c.take(pa.array(np.zeros(n, np.int64))) for c in here]
                    yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, made), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema.names)
                if lines:
                    begin, end = at[words.starts], at[words.ends]
                    places = np.array([x["place"] for x in lines], np.int64)
                    i, j = np.searchsorted(begin, places >> 32), np.searchsorted(end, places & 0xFFFFFFFF) + 1
                    every = words.windows(min(SHINGLE_WORDS, len(words)))
                    sets = [np.unique(every[a : max(a + 1, b - SHINGLE_WORDS + 1)]).view(np.int64) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
                    n = len(lines)
                    ids = [c.take(pa.array(np.zeros(n, np.int64))) for c in here]
                    none = [pa.nulls(n, pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([*ids, *none, pa.array([x["key"] for x in lines], pa.int64()), _lists(tuple(sets))], schema.names)

    return near.select("doc_id", "text_hash", "text", "open", "lines").mapInArrow(apply, schema)


def _spans(places: np.ndarray) -> str:
    """start:end of places, overlapping or touching ones made one, comma-joined."""
    if not len(places):
        return ""
    places = np.sort(places)
    start, end = places >> 32, np.maximum.accumulate(places & 0xFFFFFFFF)
    fresh = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    last = np.append(fresh[1:], len(places)) - 1
    return ",".join(f"{a}:{b}" for a, b in zip(start[fresh].tolist(), end[last].tolist(), strict=True))


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` with the arrays ``repeated`` and ``removed`` as merged spans."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("repeated", "removed") else f for f in rows.schema])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [pa.array([_spans(x.values.to_numpy()) for x in batch.column(n)], pa.string()) for n in ("repeated", "removed")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *text], schema.names)

    return rows.mapInArrow(apply, schema)


def _once(rows: DataFrame, twins: bool) -> DataFrame:
    """Rows that agree in doc_id and text are one document; without any such
    ``twins`` nothing needs to be compared."""
    return rows.distinct() if twins else rows


def _windows(units: DataFrame, twins: bool) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """doc_id, text_hash, place, hash, ``n``, ``goes``, ``bridge n`` and ``bridge
    goes`` of every taken window that stands twice; the last two are null where
    its bridge does not. And the tables that are read for it."""
    each = units.select(*_WHERE, F.explode(F.arrays_zip("places", "hashes", "bridges")).alias("x"))
    flat = each.select(*_WHERE, F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"), F.col("x.bridges").alias("bridge"))
    twice = flat.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    # twins are no second place
    hits = written(_once(flat.join(twice.hint("merge"), "hash"), twins), "para-hits")
    own = written(_repeating(hits, ["hash"]), "para-own")
    dropped(hits)
    bridges = _repeating(own.where("bridge <> 0").select(*_WHERE, "place", "bridge"), ["bridge"])
    bridges = written(bridges.select(F.col("doc_id").alias("b id"), F.col("text_hash").alias("b hash"), F.col("place").alias("b place"), F.col("n").alias("bridge n"), F.col("goes").alias("bridge goes")), "para-bridges")
    same = F.col("doc_id").eqNullSafe(F.col("b id")) & (F.col("text_hash") == F.col("b hash")) & (F.col("place") == F.col("b place"))
    return own.join(bridges, same, "left").select(*_WHERE, "place", "hash", "n", "goes", "bridge n", "bridge goes"), (own, bridges)


def _line_classes(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (doc_id, text_hash, place, h1, h2), their classes (h1, h2, key,
    first) and the members of bands with two classes or more (bucket, key)."""
    each = units.select(*_WHERE, "line bands", F.posexplode(F.arrays_zip("line places", "line h1", "line h2")).alias("i", "x"))
    own = F.slice("line bands", F.col("i") * BANDS + 1, F.lit(BANDS))
    lines = written(each.select(*_WHERE, F.col("x.line places").alias("place"), F.col("x.line h1").alias("h1"), F.col("x.line h2").alias("h2"), own.alias("bands")), "para-lines")
    classes = lines.groupBy("h1", "h2").agg(_first("doc_id", "text_hash", "place"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "para-classes")
    dealt = classes.select("key", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return lines.drop("bands").distinct(), classes, written(dealt.join(full, "bucket"), "para-members")


def repeated(docs: DataFrame) -> DataFrame:
    """One row per document with a passage that stands elsewhere too, in another
    document or again in its own.

    doc_id; class_id (least content hash among its repeated paragraphs, as 16
    hex digits); n_repeated; ``repeated`` and ``removed``: start:end spans in
    code points, merged and comma-joined: all that repeats, and what goes when
    the first place (by doc_id, null last, then the text's hash, then place) of
    each class or component stays. Spans reach the ends of what is shared.

    A passage has LEAST_WORDS words or more, or is the whole of a shorter text.
    Null and empty texts have none; rows that agree in doc_id and text are one
    document; very long texts are hashed in slabs, so their memory is a few times
    their size; other columns are ignored; an empty table gives an empty result.
    """
    units = written(paragraphs(docs), "para-units")
    twins = not units.groupBy(*_WHERE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    windows, read = _windows(units, twins)
    lines, classes, members = _line_classes(units)
    dropped(units)

    # all that one pass over the texts has to look at, by document
    asked = classes.join(members.select("key").distinct(), "key", "left_semi")
    asked = asked.select("first.doc_id", "first.text_hash", F.struct("key", "first.place").alias("line"))
    none = F.lit(None)
    anchor = F.struct("place", "n", "bridge n", "goes", "bridge goes", "hash")
    rows = windows.select(*_WHERE, anchor.alias("anchor")).withColumn("line", none.cast(asked.schema["line"].dataType))
    rows = rows.union(asked.select(*_WHERE, none.cast(rows.schema["anchor"].dataType).alias("anchor"), "line"))
    by_doc = written(rows.groupBy(*_WHERE).agg(F.array_sort(F.collect_list("anchor")).alias("anchors"), F.collect_list("line").alias("lines")), "para-docs")
    for old in read:
        dropped(old)
    # an end is closed where the bridge repeats at all places of the window; where
    # only some have it, the first of those stands for them beside the others
    closed = lambda bridge, x: F.coalesce((bridge["bridge n"] == x["n"]) | bridge["bridge goes"], F.lit(False))
    left = lambda x, i: F.when((i > 0) & closed(F.get("anchors", i - 1), x), 0).otherwise(1)
    right = lambda x: F.when(closed(x, x), 0).otherwise(2)
    ends = F.transform("anchors", lambda x, i: F.shiftleft(F.shiftrightunsigned(x["place"], 32), 2).bitwiseOR(left(x, i) + right(x)))
    opened = F.filter(ends, lambda x: x.bitwiseAND(F.lit(3)) != 0)
    near = written(near_texts(by_doc.select(*_WHERE, opened.alias("open"), "lines"), docs), "para-near")

    sets = written(near.where("key IS NOT NULL").select("key", "set").dropDuplicates(["key"]), "para-sets")
    label = similar_links(members, sets, "para")
    for old in (members, sets):
        dropped(old)
    known = classes.select("h1", "h2", "key").join(label, "key", "left").select("h1", "h2", F.coalesce("component", "key").alias("component"))
    lines = written(lines.join(known, ["h1", "h2"]), "para-known")
    grown = _once(near.where("key IS NULL").select(*_WHERE, "place", "h1", "h2"), twins)

    place = lambda start, end: start.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(end.bitwiseAND(F.lit(0xFFFFFFFF)))
    bridge = F.transform("anchors", lambda x, i: F.struct(place(x["place"], F.get("anchors", i + 1)["place"]).alias("place"), x["bridge goes"].alias("goes"), x["hash"]))
    bridges = by_doc.select(*_WHERE, F.explode(F.filter(bridge, lambda x: x["goes"].isNotNull())).alias("x")).select(*_WHERE, "x.place", "x.goes", "x.hash", F.lit(0).alias("hit"))
    own = by_doc.select(*_WHERE, F.explode("anchors").alias("x")).select(*_WHERE, "x.place", "x.goes", "x.hash", F.lit(1).alias("hit"))
    parts = own.union(bridges)
    parts = parts.union(_repeating(lines, ["component"]).select(*_WHERE, "place", "goes", F.col("h1"), F.lit(1)))
    parts = parts.union(_repeating(grown, ["h1", "h2"]).select(*_WHERE, "place", "goes", none.cast("long"), F.lit(0)))
    found = parts.groupBy(*_WHERE).agg(
        F.min("hash").alias("class"), F.sum("hit").alias("n_repeated"),
        F.collect_list("place").alias("repeated"), F.collect_list(F.when(F.col("goes"), F.col("place"))).alias("removed"),
    )
    return _merged(found.select("doc_id", F.lower(F.lpad(F.hex("class"), 16, "0")).alias("class_id"), "n_repeated", "repeated", "removed"))
