"""Operator 5: language identification by bit-sliced Bloom filters of n-grams.

One table of rows, each a bitmask with a bit per language, holds the filters of all languages side by side: an n-gram
is looked up once, and the AND of its rows is the set of languages that (seem to) contain it. Per language the hits
are counted; of N n-grams with false-positive rate p, c hits mean (c - N p) / (1 - p) true ones; the language with
the most true hits is the answer, their share of N the score.

The filters are learned from a bounded sample of labelled rows: at most `per_language` documents of each language,
taken by a hash of the id; there is a bit for every language, in as many words as it takes. An n-gram belongs to a
language if it is common enough there, absolutely and against the language where it is most common.

Defined results: `und` and score 0 for a null text and for one without a letter, and for all if nothing was learned;
ties go to the language that sorts first; a row is judged by its text alone, so equal texts have equal answers; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.llm.common import materialize

N = 4
PROBES = 3


def windows(text: str, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """The N-byte windows of the lower-cased text between blanks, as integers, in slices that overlap, so that none is lost or added."""
    data = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace") + b"  ", np.uint8)
    for at in range(0, len(data) - N + 1, step):
        part = data[at : at + step + N - 1].astype(np.uint32)
        out = part[: len(part) - N + 1].copy()
        for i in range(1, N):
            out |= part[i : len(part) - N + 1 + i] << np.uint32(8 * i)
        yield out


def probes(g: np.ndarray, rows: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(i) * b) & np.uint64(rows - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # a row per slot, of as many words of bits as the languages need
    false: np.ndarray  # false-positive rate per language
    default: str

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], default: str) -> Filters:
        distinct = sum(map(len, members))
        rows = 1 << max(10, int(np.ceil(np.log2(8 * distinct + 1))))
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(k).itemsize * 8), np.uint64)
        bits = np.dtype(kind).itemsize * 8
        table = np.zeros((rows, -(-len(languages) // bits)), kind)
        for i, g in enumerate(members):
            for at in probes(g, rows):
                table[at, i // bits] |= kind(1 << i % bits)
        fill = np.array([np.mean((table[:, i // bits] >> kind(i % bits)) & kind(1)) for i in range(len(languages))])
        return cls(languages, table, fill**PROBES, default)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The set of languages of each n-gram."""
        first, *rest = probes(g, len(self.table))
        out = self.table[first]
        for at in rest:
            out &= self.table[at]
        return out

    def counts(self, g: np.ndarray) -> np.ndarray:
        """Per language the n-grams that it truly contains, as estimated."""
        m, k = self.masks(g), len(self.languages)
        if self.table.dtype == np.uint8:
            per = np.bincount(m[:, 0], minlength=256)
            hits = np.array([per[(np.arange(256) >> i) & 1 == 1].sum() for i in range(k)])
        else:
            bits, kind = self.table.dtype.itemsize * 8, self.table.dtype.type
            hits = np.array([np.count_nonzero(m[:, i // bits] & kind(1 << i % bits)) for i in range(k)])
        return (hits - len(g) * self.false) / (1 - self.false)

    def decide(self, text: str) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for g in windows(text):
            total += self.counts(g)
            n += len(g)
        best = int(np.argmax(total))
        score = float(min(1.0, max(0.0, total[best] / max(n, 1))))
        return (self.languages[best], score) if score > 0 else (self.default, 0.0)


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 3000, least: float = 2e-6, against: float = 0.1) -> Filters | None:
    """Filters from a bounded sample of labelled rows; None if there are none."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()  # a row per language
    if not sizes:
        return None
    share = docs_share(rows.sparkSession, sizes, per_language)
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select(F.col(lang).alias("lang"), F.col(text).alias("x"), hashed.alias("at")).join(share, "lang").where("at < share").select("lang", "x")

    def count(batches):
        import pyarrow as pa

        held: dict[str, list[np.ndarray]] = {}

        def told():
            for name, parts in held.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for g in windows(x.as_py()):
                    held.setdefault(name, []).append(g)
                    size += len(g)
                    if size > 1 << 23:
                        yield from told()
                        size = 0
        yield from told()

    per = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    per = materialize(per, "grams")
    total = F.broadcast(per.groupBy("lang").agg(F.sum("n").alias("total")))  # a row per language
    rated = per.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    # An n-gram has a row per language at most; those that stay are 1 / least per language at most.
    rated = rated.withColumn("top", F.max("rate").over(W.partitionBy("gram"))).where((F.col("rate") >= least) & (F.col("rate") >= against * F.col("top")))
    found = {name: part.gram.to_numpy() for name, part in rated.select("lang", "gram").toPandas().groupby("lang")}
    names = sorted(r.lang for r in sizes if r.lang in found)
    if not names:
        return None
    return Filters.build(names, [found[name] for name in names], sizes[0].lang if sizes[0].lang in names else names[0])


def docs_share(spark: SparkSession, sizes: list, per_language: int) -> DataFrame:
    """(lang, share) of the rows of each language that are learned from."""
    rows = [(r.lang, min(1.0, per_language / r["count"])) for r in sizes]
    return F.broadcast(spark.createDataFrame(rows, "lang string, share double"))


def predict(docs: DataFrame, filters: Filters | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # some MB at most: the sample is bounded

    def run(batches):
        import pyarrow as pa
        import regex

        letter, own = regex.compile(r"\p{L}"), held.value
        for batch in batches:
            out = []
            for x in batch.column(1):
                t = x.as_py()
                out.append(own.decide(t) if own and t and letter.search(t) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("x")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0
