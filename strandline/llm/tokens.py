"""Token ids in ORC: range-partitioned shards, in ascending doc_id order.

Each shard is one ORC file of (shard, doc_id, within, n_tokens, ids). Ids are
integer run-length encoded inside stripes; row indexes hold the least and
greatest doc_id of every row group and a Bloom filter answers point lookups, so
readers split files by stripe and skip what a filter on doc_id rules out.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import new_path

END_ID = 1
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000
#: Distinct words kept with their ids by one Python worker.
CACHE_WORDS = 200_000


#: Byte-level alphabet: printable bytes stand for themselves, the others for
#: the characters from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_MARKS = ".,!?;:*#%&$|<>()[]{}\"-_/+=~@^`\\"


class WordIds:
    """Ids of whole texts from ids of their words.

    The tokenizer lower-cases, drops white space, and no token crosses it, so a
    text's ids are its words' ids in order, and case need not be told apart. A
    word of Latin letters alone is one piece for the tokenizer's model, and
    marks behind its last letter are another; other words take the whole
    tokenizer. Words used lately are kept, in two generations of CACHE_WORDS.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _letters(self, word: str, key: bytes) -> bytes:
        """Ids of a lower-case word of Latin letters."""
        found = self.known.get(key) or self.old.get(key)
        if found is None:
            piece = word if word.isascii() else key.decode("latin-1").translate(_ALPHABET)
            found = array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()
        self.known[key] = found
        return found

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        """Makes ids of all ``words`` known."""
        known, old, rest = self.known, self.old, []
        for key in [w for w in words if w not in known]:
            if key in old:
                known[key] = old[key]
                continue
            word = key.decode()
            base = word if word[-1] not in _MARKS else word.rstrip(_MARKS)
            latin = base.isascii() or max(base) < "\u0100"
            if not (latin and base.isalpha()) or "<|" in word:
                rest.append(key)
            elif base is word:
                low = word.lower()
                known[key] = self._letters(low, key if low == word else low.encode())
            else:
                tail = word[len(base) :]
                if tail not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks.clear()
                    self.marks[tail] = self._whole([tail])[0]
                low = base.lower()
                known[key] = self._letters(low, low.encode()) + self.marks[tail]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, self._whole([w.decode() for w in part]), strict=True))

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids, with the end id, of every text (UTF-8)."""
        # at ASCII white space alone; special tokens are matched before lower-casing
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        self._learn(set().union(*split))
        end = np.array([END_ID], "<i4").tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + end, "<i4") for words in split]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that its words serve the worker's next tasks."""
    return WordIds(path)


def encoded(docs: DataFrame, tokenizer_path: str, shards: int) -> DataFrame:
    """shard, doc_id, within (ids of the shard before it), n_tokens, ids."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("within", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, shard = word_ids(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = ids.of([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                sizes = np.array([len(r) for r in rows], np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), part.column(0), pa.array(at + ends - sizes), pa.array(sizes), lists], schema.names)
                at += int(ends[-1])

    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return dealt.mapInArrow(apply, schema)


def write(docs: DataFrame, path: str, tokenizer_path: str, shards: int | None = None) -> None:
    """Writes the token shards of ``docs``. Null texts are empty; every document
    gets the end id; null ids come first; rows with one id follow their texts'
    hashes; other columns are ignored; an empty table writes an empty folder."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    options = {
        "orc.compress": "ZSTD",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_INDEX_STRIDE),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    encoded(docs, tokenizer_path, shards).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, within, n_tokens, ids, and ``start``: ids of all documents
    before it. The shards' totals come from the small columns alone and number
    as many as the shards."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row a shard, and a shard is a file: the offsets are small at any size
    return rows.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("within")).drop("before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read`` returns."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], schema.names)

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(apply, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to ``path`` (by default a new shared folder), reads the
    files back and returns their checksums."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    write(docs, path, tokenizer_path)
    return checksums(read(spark, path))
