"""Models written once, bucketed by transcript.

Tables that joins meet by ``_tx_id`` are written in the same number of buckets
of that key, so that joining or grouping by it needs no exchange. Splicing,
exons and CDS parts are kept joined (``bundle``), as nearly every query reads
them together. A table is written when something first asks for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.model import GeneModel

#: Rows of the longest table in one bucket, which a task sorts in memory, and the
#: most buckets Spark takes. Bytes tell less: packed files may be a tenth of others.
BUCKET_ROWS, MAX_BUCKETS = 1 << 19, 100_000
BY_TRANSCRIPT = ("rows", "bundle", "transcript", "gene")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: from ``spark.checkpoint.dir``. A local
    session that has none gets one under /tmp; a cluster is refused."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/strandline-checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


class StoredTables(Mapping):
    """The tables of a model by name. ``make`` has a function of this mapping for
    each; those in ``kept`` are written, others are views of what is. Beside the
    model's seven there may be more, such as ``bundle``. Those in ``dealt`` come
    hash-partitioned by transcript into as many parts as there are buckets."""

    def __init__(self, spark: SparkSession, make: Mapping[str, Callable[[Mapping], DataFrame]], kept: tuple[str, ...], buckets: int, dealt: tuple[str, ...] = ()):
        self.spark, self.buckets, self.dealt = spark, buckets, dealt
        self._make, self._kept = make, kept
        self._ready: dict[str, DataFrame] = {}
        self._token = uuid.uuid4().hex

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            df = self._make[name](self)
            self._ready[name] = self._written(name, df) if name in self._kept else df
        return self._ready[name]

    def __iter__(self) -> Iterator[str]:
        return iter(schema.TABLES)

    def __len__(self) -> int:
        return len(schema.TABLES)

    @property
    def bundle(self) -> DataFrame | None:
        return self["bundle"] if "bundle" in self._make else None

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        path, table = f"{shared_folder(self.spark)}/model-{self._token}/{name}", f"strandline_{self._token}_{name}"
        if name not in BY_TRANSCRIPT:
            df.write.option("compression", "zstd").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        df = df if name in self.dealt else df.repartition(self.buckets, "_tx_id")
        dealt = df.write.bucketBy(self.buckets, "_tx_id").sortBy("_tx_id")
        dealt.format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        """Forgets the written tables and deletes their files."""
        for name in [n for n in self._ready if n in self._kept and n in BY_TRANSCRIPT]:
            self.spark.sql(f"DROP TABLE IF EXISTS strandline_{self._token}_{name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/model-{self._token}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._ready.clear()


def bundled(splicing: DataFrame, exon: DataFrame, cds: DataFrame) -> DataFrame:
    """Splicing rows with the columns of their exon and, where there is one, CDS part."""
    return splicing.join(exon, "_exon_id").join(cds, "_cds_id", "left")


def buckets_for(spark: SparkSession, rows: int) -> int:
    return min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))


def stored(model: GeneModel, buckets: int | None = None) -> GeneModel:
    """``model`` with its tables written on first use; the user's view of its
    chromosomes stays."""
    from dataclasses import replace

    make = {name: (lambda _, name=name: model[name]) for name in schema.TABLES}
    make["bundle"] = lambda t: bundled(model["splicing"], model["exon"], model["cds"])
    make["splicing"] = lambda t: t["bundle"].select(*schema.TABLES["splicing"].fieldNames())
    kept = ("bundle", "transcript", "gene", "exon", "cds", "chrominfo", "metadata")
    return replace(model, tables=StoredTables(model.spark, make, kept, buckets or buckets_for(model.spark, 0)))


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """Bytes of all files below ``paths``, and a hash of their names, sizes and
    times. Spark lists them; nothing is opened."""
    files = spark.read.format("binaryFile").load(paths)
    row = files.agg(F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash")).first()
    return row["size"] or 0, row["hash"] or 0
