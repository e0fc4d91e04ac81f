"""Operator 4: a quality classifier by importance resampling.

Two generative models over hashed n-grams (words and marks, pairs of them, and any word five times in a row) are fitted
to labelled rows: the target model to the good ones, the raw model to all. A document's log weight is the sum of
log target/raw over its distinct n-grams. The share of target rows among the rows with an n-gram, on which that ratio
rests, is smoothed by an empirical prior with two parts: most n-grams say nothing, so their shares scatter (by a Beta
distribution of `scatter` rows) around a usual one; a few may have any share. `telling` says how many of them are expected (for the run of
one word, for words, for pairs), however many n-grams there are, as else the many pairs would give many by chance. The log ratio is weighted by the probability that the n-gram is one of the few. So evidence for and against the target counts by
its strength, n-grams that the labelled rows hardly show have ratio 1, and length doesn't carry a text off. Equal texts count
once, and an n-gram once a text: the many repeats within a text are not independent evidence.

Gumbel noise is added to the log weights, divided by `temperature` (1 samples in proportion to the weights; the default of 0.25
in proportion to their fourth power, so that few documents near the cut change sides), and the k documents with the largest
sums stay: Gumbel top-k, which is sampling without replacement. k is a parameter, `keep`: a share of the
documents (below 1) or a number of them; by default the number of documents on the target's side of a cut
that is fitted on the labelled rows.

The models are fitted on at most about `most` labelled rows, taken by a hash of the id; weights, k and the top-k cover every
document. The k-th largest key is found by counting in ever finer bins, never by sorting everything in one place.

Defined results: a null text is an empty one, its weight is 0; rows are judged one by one, with noise that depends on id
and text, so repeated rows stay or go together, except that ties at the k-th key all stay; without labelled rows of both kinds
everything stays; an empty table gives no row; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import Memory, fresh, materialize, small_batches

#: Half for words, half for pairs, so that rare pairs do not blur the words.
BUCKETS = 1 << 21
TOKEN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 100_000


class Hasher:
    """Bucket numbers of the n-grams of a text; remembers words."""

    known = Memory(REMEMBERED, "resample")

    @classmethod
    def grams(cls, text: str) -> np.ndarray:
        import xxhash

        words = TOKEN.findall(text.lower())
        known = cls.known
        for w in known.missing(set(words)):
            known.young[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 5)
        h = np.fromiter(map(known.young.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
            pairs ^= pairs >> np.uint64(33)
        half, same = np.uint64(BUCKETS // 2), h[1:] == h[:-1]
        run = len(same) > 3 and bool((same[3:] & same[2:-1] & same[1:-2] & same[:-3]).any())
        return np.unique(np.concatenate([np.zeros(int(run), np.uint64), np.uint64(1) + h % (half - np.uint64(1)), half + pairs % half])).astype(np.int64)


def stretches(text: str, size: int = 1 << 18):
    from anamnesis.llm.common import blocks

    return blocks(text, size)


@dataclass
class Model:
    ratio: np.ndarray
    cut: float

    def weight(self, text: str | None) -> float:
        return float(self.ratio[grams(text or "")].sum())


def grams(text: str) -> np.ndarray:
    """Distinct buckets of a whole text, stretch by stretch."""
    parts = [Hasher.grams(part) for part in stretches(text)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def log_ratios(bucket: np.ndarray, t: np.ndarray, r: np.ndarray, usual: float, scatter: float, telling: tuple[float, float, float]) -> np.ndarray:
    """log target/raw of n-grams that t of r rows with them are target rows of; `usual` is the share that says nothing."""
    top = int(r.max()) + 1

    def log_beta(x: np.ndarray, y: np.ndarray, a: float, b: float) -> np.ndarray:
        """log B(x + a, y + b) - log B(a, b), from tables over whole x and y."""
        ga, gb, gab = (np.array([math.lgamma(k + c) for k in range(top)]) for c in (a, b, a + b))
        return ga[x] + gb[y] - gab[x + y] - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    kind = np.where(bucket == 0, 0, np.where(bucket < BUCKETS // 2, 1, 2))
    before = np.minimum(0.5, np.array(telling) / np.maximum(np.bincount(kind, minlength=3), 1))[kind]
    plain = log_beta(t, r - t, usual * scatter, (1 - usual) * scatter)
    other = np.log(before) + log_beta(t, r - t, 0.5, 0.5)
    chance = 1 / (1 + np.exp(np.clip(plain - other, -500, 500)))
    return chance * (np.log((t + 0.5) / (r + 1)) - np.log(usual))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, scatter: float = 6.0, telling: tuple[float, float, float] = (0.5, 10.0, 1.0), common: float = 5e-4, key: str = "doc_id", text: str = "text") -> Model | None:
    """labels: doc_id, quality, toxic. Good: quality 1 and not toxic. None without rows of both kinds."""
    spark = docs.sparkSession
    given = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good")).where(F.col("good").isNotNull())
    given = materialize(given, "labels")
    n = given.count()
    if not n:
        return None
    share = min(1.0, 0.95 * most / n)
    chosen = given.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x")).join(F.broadcast(chosen), "doc_id").select("good", "x").dropDuplicates(["x"])  # broadcast: about `most` rows of nine bytes
    rows = materialize(rows, "sample")

    def count(batches):
        Memory.only("resample")
        t, r = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for good, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = grams(x.as_py())
                r[own] += 1
                if good:
                    t[own] += 1
        at = np.flatnonzero(r)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t[at].astype(np.int64)), pa.array(r[at].astype(np.int64))], names=["bucket", "t", "r"])

    n, n_good = rows.agg(F.count("*"), F.sum(F.col("good").cast("int"))).first()
    if not n_good or n_good == n:
        return None
    counts = rows.mapInArrow(count, "bucket long, t long, r long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    # What so few rows hold can't tell anything at these priors; of a text's n-grams at most some thousand are in a share of the rows.
    per = counts.where(F.col("r") >= max(3, common * n)).toPandas()
    ratio = np.zeros(BUCKETS, np.float32)
    if len(per):
        t, r = per.t.to_numpy(), per.r.to_numpy()
        often = r >= np.quantile(r, 0.99)
        usual = min(max(float(np.median(t[often] / r[often])), n_good / n), 1 - 0.5 / n)
        ratio[per.bucket] = log_ratios(per.bucket.to_numpy(), t, r, usual, scatter, telling)
    model = Model(ratio, 0.0)
    scored = rows.select("good", weights(spark, model)(F.col("x")).alias("w")).toPandas()  # `most` rows
    model.cut = best_cut(scored.w.to_numpy(), scored.good.to_numpy(bool))
    return model


def best_cut(w: np.ndarray, good: np.ndarray, care: float = 4.0) -> float:
    """The cut with the least loss, a lost good row counting `care` times a kept bad one; halfway to the next weight."""
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    loss = care * np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1) + np.concatenate([np.cumsum((~good)[::-1])[::-1], [0]]) / max((~good).sum(), 1)
    ends = np.concatenate([[True], w[1:] > w[:-1], [True]])  # rows of one weight stay together
    at = int(np.argmin(np.where(ends, loss, np.inf)))
    if at == 0:
        return float(w[0]) - 1.0
    return float(w[at - 1] + w[at]) / 2 if at < len(w) else float(w[-1])


def weights(spark, model: Model):
    held = spark.sparkContext.broadcast(model)  # BUCKETS floats

    @F.arrow_udf("double")
    def weight(x: pa.Array) -> pa.Array:
        Memory.only("resample")
        own = held.value
        return pa.array([own.weight(t.as_py()) for t in x], pa.float64())

    return weight


def kth_largest(keys: DataFrame, k: int, column: str = "g", bins: int = 4096, small: int = 20_000) -> float:
    """The k-th largest value, by counting in bins between bounds that close in; the last few are collected."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float(low)
    x, above = F.col(column), 0
    while True:
        inside = keys.where((x >= low) & (x <= high))
        step = (high - low) / bins
        if n <= small or step <= abs(high) * 1e-15:
            values = sorted((r[0] for r in inside.select(column).orderBy(x.desc()).limit(small).collect()), reverse=True)
            return float(values[min(k - above, len(values)) - 1])
        at = F.least(F.lit(bins - 1), F.floor((x - F.lit(low)) / step))
        counts = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.bin)
        for r in counts:
            if above + r.n >= k:
                low, high, n = r.lo, r.hi, r.n
                break
            above += r.n


def scored(docs: DataFrame, model: Model, names: tuple[str, str] = ("weight", "gumbel"), seed: int = 17, temperature: float = 0.25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the log weight and the Gumbel key in columns of the given names."""
    weight, gumbel = names
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), 11) + F.lit(0.5)) / float(1 << 53)
    rows = docs.withColumn(weight, weights(docs.sparkSession, model)(F.col(text)))
    return rows.withColumn(gumbel, F.col(weight) / F.lit(temperature) - F.log(-F.log(u)))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, temperature: float = 0.25, key: str = "doc_id", text: str = "text", with_text: bool = True, **fitting) -> DataFrame:
    """The documents that stay: all columns of docs, or without `with_text` the id, log_weight and gumbel_key."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, key=key, text=text, **fitting)
    if model is None:
        return docs if with_text else docs.select(key, F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"))
    weight, gumbel = fresh(docs, "weight", "gumbel")
    rows = scored(docs, model, (weight, gumbel), temperature=temperature, key=key, text=text)
    rows = materialize(rows if with_text else rows.select(key, weight, gumbel), "weights")
    if keep is None:
        k = rows.where(F.col(weight) > model.cut).count()
    else:
        k = round(keep * rows.count()) if keep < 1 else int(keep)
    kept = rows.where(F.col(gumbel) >= kth_largest(rows.select(F.col(gumbel).alias("g")), k)) if k else rows.limit(0)
    return kept.select(*docs.columns) if with_text else kept.select(key, F.col(weight).alias("log_weight"), F.col(gumbel).alias("gumbel_key"))
