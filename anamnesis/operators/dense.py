"""Exact dense retrieval: unit vectors, cosine from squared distance, the k nearest per question."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions.numbers import places

#: Decimals at which scores are compared, rows and questions that meet at once, pairs whose distances are worked out at once.
DECIMALS, ROWS, ASKED, PAIRS = 12, 2048, 512, 1 << 15
SCALE = 10.0**DECIMALS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Components that one of the two doesn't have count as equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))


def score(distance: Column) -> Column:
    """Cosine of unit vectors from their squared distance, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance / 2))


def dense_candidates(vectors: DataFrame, questions: DataFrame, k: int, key: str, vector: str, question_key: str, question_vector: str, scope: list[str] | None = None, most: int = 5_000) -> DataFrame:
    """(question, doc, dense_score, rank): the k nearest rows of each question, exactly. Ties, at DECIMALS, go to the smaller key.

    Within a scope the questions meet its rows by an equi-join. Without one, a stated set of questions is matched
    against all rows, in blocks of about `most` questions that are broadcast one after the other; each task keeps only its own
    k best per question before anything is shuffled."""
    asked = questions.select(*(scope or []), F.col(question_key).alias("question"), F.col(question_vector).alias("qv"))
    rows = vectors.select(*(scope or []), F.col(key).alias("doc"), F.col(vector).alias("v"))
    if scope:
        scored = rows.join(asked, scope).select(*scope, "question", "doc", score(squared_distance(F.col("qv"), F.col("v"))).alias("dense_score"))
        return ranked(scored, places(F.col("dense_score"), DECIMALS), k)
    blocks = max(1, -(-asked.count() // most))
    block = F.pmod(F.xxhash64("question"), F.lit(blocks))
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("doc")
    parts = [nearest(dealt, asked.where(block == i) if blocks > 1 else asked, k) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def ranked(scored: DataFrame, at: Column, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("question").orderBy(at.desc(), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of doubles, and which components are not there (null, or the list is shorter)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    out, missing = np.zeros((len(sizes), sizes.max(initial=0))), np.ones((len(sizes), sizes.max(initial=0)), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    missing[row, at] = pc.is_null(flat).to_numpy(zero_copy_only=False)
    return out, missing


def widened(vectors: np.ndarray, missing: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    more = ((0, 0), (0, width - vectors.shape[1]))
    return (np.pad(vectors, more), np.pad(missing, more, constant_values=True)) if more[1][1] else (vectors, missing)


class Best:
    """The k best rows of each question among those seen so far. Rows come in ascending order of their keys, so of equal ones the first stays.

    A product of matrices tells, within its rounding, which rows may be among them; only these pairs get their
    distance, summed component by component."""

    def __init__(self, vectors: np.ndarray, missing: np.ndarray, k: int):
        self.vectors, self.missing, self.k, self.seen = vectors, missing, k, 0
        self.points = np.full((len(vectors), k), -1, np.int64)
        self.scores, self.rows = np.zeros((len(vectors), k)), np.full((len(vectors), k), -1, np.int64)

    def add(self, vectors: np.ndarray, missing: np.ndarray) -> None:
        width = max(vectors.shape[1], self.vectors.shape[1])
        self.vectors, self.missing = widened(self.vectors, self.missing, width)
        vectors, missing = widened(vectors, missing, width)
        for at in range(0, len(vectors), ROWS):
            v, gone = vectors[at : at + ROWS], missing[at : at + ROWS]
            plain = np.isfinite(v).all(1) & ~gone.any(1)
            w = np.where(plain[:, None], v, 0.0)
            for i in range(0, len(self.vectors), ASKED):
                self.meet(slice(i, i + ASKED), v, gone, w, plain)
            self.seen += len(v)

    def meet(self, own: slice, v: np.ndarray, gone: np.ndarray, w: np.ndarray, plain: np.ndarray) -> None:
        q, q_gone, points = self.vectors[own], self.missing[own], self.points[own]
        q_plain = np.isfinite(q).all(1) & ~q_gone.any(1)
        p = np.where(q_plain[:, None], q, 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            pn, wn = np.einsum("ij,ij->i", p, p) / 2, np.einsum("ij,ij->i", w, w) / 2
            about = p @ w.T
            about += 1 - pn[:, None]
            about -= wn
            slack = 10 / SCALE + 4e-16 * (q.shape[1] + 8) * (1 + pn.max() + wn.max())
        if not np.isfinite(slack):  # squares that are no doubles: nothing is told apart beforehand
            may = np.ones(about.shape, bool)
        else:
            last = points[:, -1]
            least = last / SCALE - slack
            least[last >= SCALE] = np.inf  # nothing comes before k equal vectors that were first
            new = np.flatnonzero(last < 0)
            if len(new):
                least[new] = -np.inf
                if len(v) > self.k:
                    kth = np.partition(about[new], -self.k, axis=1)[:, -self.k]
                    some = (kth > slack) & plain.all() & q_plain[new]
                    least[new[some]] = kth[some] - slack
            may = about >= least[:, None]
            may |= (~q_plain)[:, None] | ~plain
        qi, vi = np.nonzero(may)
        if len(qi):
            found = np.concatenate([self.exact(q, q_gone, v, gone, qi[at : at + PAIRS], vi[at : at + PAIRS]) for at in range(0, len(qi), PAIRS)])
            self.merge(own.start, qi, vi + self.seen, found)

    @staticmethod
    def exact(q, q_gone, v, gone, qi, vi) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            x = q[qi] - v[vi]
            x *= x
            x[q_gone[qi] | gone[vi]] = 0.0
            total = np.zeros(len(x))
            for d in range(x.shape[1]):
                total += x[:, d]
            out = 1.0 - total / 2
        out[np.isnan(out)] = 1.0  # as in SQL, where NaN comes after all numbers
        return np.clip(out, 0.0, 1.0)

    def merge(self, start: int, qi: np.ndarray, rows: np.ndarray, found: np.ndarray) -> None:
        some, local = np.unique(qi, return_inverse=True)
        some += start
        held, place = np.nonzero(self.rows[some] >= 0)
        n = np.concatenate([held, local])
        points = np.concatenate([self.points[some[held], place], np.floor(found * SCALE + 0.5).astype(np.int64)])
        scores, rows = np.concatenate([self.scores[some[held], place], found]), np.concatenate([self.rows[some[held], place], rows])
        order = np.lexsort((rows, -points, n))
        n = n[order]
        rank = np.arange(len(n)) - np.searchsorted(n, n)
        kept = rank < self.k
        order, at = order[kept], (some[n[kept]], rank[kept])
        self.points[at], self.scores[at], self.rows[at] = points[order], scores[order], rows[order]


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of rows (doc, v; sorted by doc within their partitions) of each question (question, qv), which are broadcast."""
    table = asked.toArrow()
    names = table.column("question").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((names, *matrix(table.column("qv"))))

    def run(batches):
        import pyarrow as pa

        names, vectors, missing = shared.value
        best, docs = Best(vectors, missing, k), []
        for batch in batches:
            docs.append(batch.column(0))
            best.add(*matrix(batch.column(1)))
        if not docs or not len(names):
            return
        docs = pa.concat_arrays(docs)
        for at in range(0, len(names), ASKED):
            i, j = np.nonzero(best.rows[at : at + ASKED] >= 0)
            i += at
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), docs.take(pa.array(best.rows[i, j])), pa.array(best.scores[i, j]), pa.array(best.points[i, j])], names=["question", "doc", "dense_score", "points"])

    kinds = f"question {asked.schema['question'].dataType.simpleString()}, doc {rows.schema['doc'].dataType.simpleString()}, dense_score double, points long"
    return ranked(rows.mapInArrow(run, kinds), F.col("points"), k).drop("points")
