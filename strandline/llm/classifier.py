"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; the unlabelled set is
the web text itself, all of it. A linear model g over style features, cut at
their quantiles, and hashed n-grams minimises the non-negative unbiased risk
(Kiryo et al. 2017) with the squared loss l(z) = (1 - z)^2 / 4,

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).

With that loss the risk depends on the data through first and second moments
only. Spark sums them over every row, and what the driver solves has a fixed
size at any scale: nothing is sampled. The class prior is estimated from
positives and unlabelled rows alone: for any threshold, the unlabelled rows
above it are at least the prior times the positives above it (Blanchard et al.
2010), so the least ratio of the two tails bounds it. Negative labels are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import written
from strandline.llm.shingles import Words

FOLDS = 5
THRESHOLD = 0.3
FEATURES = ("length", "symbols", "capitals", "digits", "exclaims", "word_length", "distinct", "repeated", "repeated_lines", "short_words", "doubled", "very_short")
#: Buckets of the hashed word n-grams (one and two words), and of the hashed
#: runs of three bytes.
GRAMS = 64
#: Style features become steps at these quantiles of the corpus.
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)
BINS = 400
#: The prior's tails need so many positives in share, which keeps the ratio steady.
LEAST_TAIL = 0.7
#: Ridge, and what is added to it over the number of positives: few of them would
#: be told from the rest by chance, which lowers the estimated prior.
RIDGE, ROUGH_RIDGE, FIT_RIDGE = 1e-3, 60.0, 15.0
#: Score as a function of g: 0.3, 0.5 and 0.7 where the chance of label 1,
#: (g + 1) / 2, is that, and strictly rising everywhere.
SLOPE = float(np.log(0.7 / 0.3) / 0.4)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def features(words: Words, text: str | None) -> list[float]:
    """Style features of a text; null and empty texts have them too."""
    n = len(words)
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    per = max(n, 1)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    lengths = words.ends - words.starts
    lines = [x for x in raw.split(b"\n") if x.strip()]
    three = words.windows(3)
    repeated = 0.0
    if len(three):
        _, back, times = np.unique(three, return_inverse=True, return_counts=True)
        repeated = float((times[back] > 1).mean())
    return [
        float(np.log1p(n)),
        float(np.log1p(count[_SYMBOLS].sum() / per)),
        float(count[65:91].sum() / letters),
        float(np.log1p(count[48:58].sum() / per)),
        float(np.log1p(count[33] / per)),
        float(lengths.mean()) if n else 0.0,
        float(np.log1p(len(np.unique(words.hashes))) / np.log1p(per)) if n else 0.0,
        repeated,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float((lengths <= 3).mean()) if n else 0.0,
        float((words.hashes[1:] == words.hashes[:-1]).mean()) if n > 1 else 0.0,
        float(n < 30),
    ]


def grams(words: Words) -> np.ndarray:
    """Shares of the buckets of word n-grams and of three-byte runs, as roots."""
    raw = np.frombuffer(words.data, np.uint8).astype(np.uint32)
    three = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D) if len(raw) > 2 else raw[:0]
    both = np.concatenate([words.hashes, words.windows(2)]) if len(words) else np.zeros(0, np.uint64)
    counts = [np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=GRAMS) for h in (both, three.astype(np.uint64) << np.uint64(32))]
    return np.concatenate([np.sqrt(c / max(1, c.sum())) for c in counts]).astype(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, ``style`` (one double for each of FEATURES) and ``grams``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("style", T.ArrayType(T.DoubleType())), T.StructField("grams", T.ArrayType(T.FloatType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                each = [(t, Words(t)) for t in part.column(1).to_pylist()]
                style = np.array([features(w, t) for t, w in each], np.float64)
                hashed = np.array([grams(w) for _, w in each], np.float32)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (style, hashed)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], schema.names)

    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def knots(rows: DataFrame) -> np.ndarray:
    """The QUANTILES of every style feature over all rows, a row a feature."""
    cuts = F.array(*map(F.lit, QUANTILES))
    row = rows.agg(*[F.percentile_approx(F.col("style")[n], cuts, 1000).alias(f) for n, f in enumerate(FEATURES)]).first()
    return np.array([row[f] if row[f] is not None else [0.0] * len(QUANTILES) for f in FEATURES], np.float64)


def design(batch: pa.RecordBatch, cuts: np.ndarray) -> np.ndarray:
    """The model's inputs: steps of the style features, n-grams, and one."""
    n = batch.num_rows
    style = batch.column("style").flatten().to_numpy(zero_copy_only=False).reshape(n, len(FEATURES))
    hashed = batch.column("grams").flatten().to_numpy(zero_copy_only=False).reshape(n, 2 * GRAMS)
    steps = (style[:, :, None] > cuts[None]).reshape(n, -1)
    return np.hstack([steps, hashed, np.ones((n, 1))]).astype(np.float64)


def moments(rows: DataFrame, cuts: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows, and the mean of the inputs' outer products, over all ``rows``.

    Every task sums its own rows; the sums are added up by entry on Spark, and
    the driver gets one number for each pair of inputs.
    """
    d = cuts.size + 2 * GRAMS + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                x = design(batch.slice(first, 4096), cuts)
                total += x.T @ x
        upper = np.triu_indices(d)
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1], pa.int64()), pa.array(total[upper])], ["at", "sum"])

    sums = rows.select("style", "grams").mapInArrow(apply, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toPandas()
    out = np.zeros(d * d)
    out[sums["at"].to_numpy(np.int64)] = sums["sum"].to_numpy()
    out = out.reshape(d, d)
    out = out + np.triu(out, 1).T
    n = int(round(out[-1, -1]))
    return n, out / max(1, n)


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray
    weights: np.ndarray
    prior: float

    def raw(self, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The columns ``keep`` of every row, and ``g``."""
        schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("g", T.DoubleType())])
        return rows.select(*keep, "style", "grams").mapInArrow(partial(_applied, self.cuts, self.weights, len(keep), schema.names), schema)


def _applied(cuts: np.ndarray, weights: np.ndarray, keep: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(design(part, cuts) @ weights)], names)


def estimated_prior(positive: DataFrame, unlabelled: DataFrame) -> float:
    """The least ratio of the unlabelled tail to the positive one, of the scores
    ``g`` in BINS steps, where the positive tail is LEAST_TAIL or more."""
    step = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("g") + 2) * (BINS / 4)))).cast("int")

    def tail(rows: DataFrame) -> np.ndarray:
        counts = np.zeros(BINS)
        for r in rows.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["bin"]] = r["n"]
        return counts[::-1].cumsum()[::-1] / max(1, counts.sum())

    p, u = tail(positive), tail(unlabelled)
    return float(np.clip((u / np.maximum(p, 1e-9))[p >= LEAST_TAIL].min(initial=1.0), 0.02, 0.98))


def risk(w: np.ndarray, prior: float, p: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """The two parts of the risk at ``w``: of positives, and the corrected one of
    unlabelled rows, from the moments."""
    one = np.zeros(len(w))
    one[-1] = 1.0
    loss = lambda m, sign: float((one - sign * w) @ m @ (one - sign * w)) / 4
    return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = 500) -> np.ndarray:
    """The weights of least non-negative risk, from the moments of positives and
    of unlabelled rows.

    Where the corrected part is not negative the risk is one quadratic, solved
    at once. If its minimum lies where that part is negative, descent goes on
    from zero weights by Newton-scaled steps, and upwards in the corrected part
    wherever it has turned negative, as the method has it.
    """
    mp, mu = p[-1], u[-1]
    flat = np.eye(len(mu)) * ridge
    flat[-1, -1] = 0.0
    w = np.linalg.solve(u / 2 + flat, prior * mp - mu / 2)
    if risk(w, prior, p, u)[1] >= 0:
        return w
    scale = np.linalg.inv(u / 2 + prior * p / 2 + flat + 1e-9 * np.eye(len(mu)))
    w = np.zeros(len(mu))
    for _ in range(steps):
        good = prior * (p @ w - mp) / 2
        rest = (u @ w + mu) / 2 - prior * (p @ w + mp) / 2
        down = good + rest if risk(w, prior, p, u)[1] >= 0 else -rest
        w = w - 0.1 * scale @ (down + flat @ w)
    return w


def fitted(rows: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows outside the held-out fold, and the positives there."""
    learn = rows.where(fold(F.col("doc_id")) != 0)
    marks = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("label id")).distinct()
    positive = learn.join(marks, F.col("doc_id") == F.col("label id"), "left_semi")
    cuts = knots(learn)
    n_p, p = moments(positive, cuts)
    n_u, u = moments(learn, cuts)
    if not n_p or not n_u:
        return Model(cuts, np.zeros(cuts.size + 2 * GRAMS + 1), 0.5)
    first = np.linalg.solve((p + u) / 2 + (RIDGE + ROUGH_RIDGE / n_p) * np.eye(len(p)), (p[-1] - u[-1]) / 2)
    rough = Model(cuts, first, 0.5)
    prior = estimated_prior(rough.raw(positive, ()), rough.raw(learn, ()))
    return Model(cuts, fit_pu(p, u, prior, RIDGE + FIT_RIDGE / n_p), prior)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts get the score of their features; a null id counts as
    the empty text for the folds; repeated rows stay; very long texts are read
    whole; other columns are ignored; without positive labels every score is
    0.5; an empty table gives an empty result.
    """
    rows = written(featured(docs), "quality-features")
    model = fitted(rows, labels)
    score = 1 / (1 + F.exp(-SLOPE * F.greatest(F.lit(-15.0), F.least(F.lit(15.0), F.col("g")))))
    out = model.raw(rows, ("doc_id",)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
