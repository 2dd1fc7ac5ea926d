"""Near copies by SimHash and MinHash bands, verified by their five-word shingles.

Two texts are near copies if the Jaccard similarity of their five-word shingles
is SIMILARITY or more. Texts with the same words are one class. Classes whose
fingerprints the SimHash operator of op 1 links are candidates. At 0.8 most
fingerprints differ in more bits than its deletion variants reach (about ten of
64), so classes that share a MinHash band are candidates too. All are verified by
exact Jaccard of their shingle sets as the lines of op 7 are, and components
join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import dropped, written
from strandline.llm.links import similar_links
from strandline.llm.simhash import fingerprint_components, simhash_of
from strandline.llm.shingles import Words
from strandline.llm.substrings import bands, shingles_of

#: 26 bands of 5 rows find a pair of similarity 0.8 with 1 - 0.672^26 = 99.997 %,
#: and bring together 6 % of the pairs of 0.3 and one in four thousand of 0.1.
BANDS, BAND_ROWS = 26, 5


def content(words: Words) -> tuple[int, int]:
    """Two hashes of all the words, in order."""
    first, end = np.zeros(1, np.int64), np.full(1, len(words))
    return tuple(int(words.spans(first, end, salt).view(np.int64)[0]) for salt in (0, 1))


def _mapped(rows: DataFrame, keep: list[str], fields: list[T.StructField], types: list[pa.DataType], of) -> DataFrame:
    """The columns ``keep`` of every row, and what ``of`` makes of its ``text``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                made = zip(*[of(Words(t.as_py())) for t in part.column(0)], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c, t) for c, t in zip(made, types, strict=True)]], names)

    schema = T.StructType([*(rows.schema[c] for c in keep), *fields])
    names = schema.names
    return rows.select("text", *keep).mapInArrow(apply, schema)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash``, h1, h2 (of the words), ``bands`` and ``fp`` (the
    SimHash fingerprint of op 1) of every row."""

    def of(words: Words):
        fp = np.uint64(simhash_of(b" ".join(words.data.split()))).view(np.int64)
        return *content(words), bands(shingles_of(words), BANDS, BAND_ROWS).tolist(), int(fp)

    long = T.LongType()
    fields = [T.StructField("h1", long), T.StructField("h2", long), T.StructField("bands", T.ArrayType(long)), T.StructField("fp", long)]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return _mapped(rows, ["doc_id", "text_hash"], fields, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()], of)


def candidates(classes: DataFrame) -> DataFrame:
    """bucket and key of the classes (key, bands, fp) that share a band, or whose
    fingerprints are in one component of SimHash links."""
    groups = fingerprint_components(written(classes.select("fp").distinct(), "copies-prints"))
    groups = groups.select("fp", F.xxhash64(F.lit("simhash"), "component").alias("bucket"))
    dealt = written(classes.select("key", F.explode("bands").alias("bucket")).union(classes.join(groups, "fp").select("key", "bucket")), "copies-dealt")
    full = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(dealt.join(full, "bucket"), "copies-members")
    dropped(dealt)
    return members


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash`` and ``component`` (long) of every row."""
    rows = written(signed(docs), "copies-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    classes = rows.groupBy("h1", "h2").agg(first, F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "copies-classes")
    members = candidates(classes)
    here = classes.select("key", "first").join(members.select("key").distinct(), "key", "left_semi")
    d = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("d"), "text")
    near = here.join(d, F.col("first.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("first.text_hash") == F.col("d.text_hash"))).select("key", "text")

    def of(words: Words):
        return (shingles_of(words).view(np.int64).tolist(),)

    sets = _mapped(near, ["key"], [T.StructField("set", T.ArrayType(T.LongType()))], [pa.list_(pa.int64())], of)
    sets = written(sets.dropDuplicates(["key"]), "copies-sets")
    label = similar_links(members, sets, "copies")
    known = classes.select("h1", "h2", "key").join(label, "key", "left").select("h1", "h2", F.coalesce("component", "key").alias("component"))
    known = written(known, "copies-known")  # so that a class of many copies can be split over tasks
    return rows.join(known, ["h1", "h2"]).select("doc_id", "text_hash", "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: the least by
    doc_id (null ids last), then by the text's hash, then by all columns.

    Null and empty texts are copies of each other; rows that agree in all columns
    leave one; very long texts are read whole; columns of any name are safe, as
    rows are only filtered or travel as one struct. An empty table gives an empty
    result.
    """
    names = docs.columns
    of = written(labelled(docs), "copies-labels")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = of.groupBy("component").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.text_hash").distinct()
    kept = written(kept.select(F.col("doc_id").alias("kept id"), F.col("text_hash").alias("kept hash")), "copies-kept")
    # ids that stand once are taken as they are; only rows that share one are compared
    shared = of.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("kept id"), F.col("text_hash").alias("kept hash"))
    same = docs["doc_id"].eqNullSafe(F.col("kept id")) & (F.xxhash64(docs["text"]) == F.col("kept hash"))
    alone = kept.join(shared, kept["kept id"].eqNullSafe(shared["kept id"]) & (kept["kept hash"] == shared["kept hash"]), "left_anti")
    once = docs.join(alone.hint("shuffle_hash"), same, "left_semi")
    both = kept.join(shared, kept["kept id"].eqNullSafe(shared["kept id"]) & (kept["kept hash"] == shared["kept hash"]), "left_semi")
    many = docs.join(both, same, "left_semi").select(F.col("doc_id").alias("many id"), F.xxhash64("text").alias("many hash"), F.struct(*names).alias("row"))
    least = many.groupBy("many id", "many hash").agg(F.min("row").alias("row"))
    return once.union(least.select("row.*"))
