"""Operator 9: benchmark decontamination with a broadcast hash set of test windows. DataFrame operations only.

A window is `size` consecutive words of an item (a shorter item is one window). Every word position of every document
is hashed with the words that follow it and looked up in the broadcast windows; a hit counts only if its words are
those of the window. The window table is broadcast after its row count is checked; above `most` windows the same join
is left to Spark, which then shuffles both sides.

Defined results: a null text has no words; rows are judged one by one, so repeated ids give repeated rows; items
without words are ignored; an empty benchmark hits nothing; an empty table gives no row; further columns are ignored
by `contamination` and kept by `remove`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import fresh, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the table is broadcast; a window takes about 200 bytes.
MOST = 1_000_000
#: Words of the segments that texts are cut into, and of the shorter ones that those are cut into.
SEGMENT, SHORT = 1 << 14, 64


def lowered(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(n, hash, words, items): each distinct window once, with the items that hold it."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    each = words.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("words"))
    return each.groupBy("n", "words").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("words"))


def places(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))


def hits(docs: DataFrame, items: DataFrame, size: int, text: str, keep: list[str], most: int = MOST) -> DataFrame:
    """A row per document and verified hit (at, n, items); a document without hits has one row with n = 0. keep: columns carried along."""
    windows = materialize(windows_of(items, size), "windows")
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `size` values
    none = docs.sparkSession.range(1).select(F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("long").alias("hash"))
    table = windows.unionByName(none).select("n", F.coalesce("hash", F.lit(0)).alias("hash"), "words", "items")
    rows, ids = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    if rows <= most and ids <= 4 * most:
        table = F.broadcast(table)
    # A row per window would copy the words of its whole text each time; so texts are cut into long and those into short
    # segments first, each with as many words more as its last window needs. Slices stand outside of lambdas, where they
    # are compiled and touch their own words only. Explodes are outer: else Spark infers filters that work the arrays out twice.
    more = max(sizes, default=1) - 1
    cut = docs.select(*keep, words_of(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    cut = cut.select(*keep, "n_words", "w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_words") - 1) / SEGMENT).cast("int")))).alias("s"))
    cut = cut.select(*keep, "n_words", (F.col("s") * SEGMENT).alias("off"), F.slice("w", F.col("s") * SEGMENT + 1, F.lit(SEGMENT + more)).alias("w"))
    cut = cut.select(*keep, "n_words", "off", "w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.least(F.size("w"), F.lit(SEGMENT)) - 1) / SHORT).cast("int")))).alias("s"))
    cut = cut.select(*keep, "n_words", (F.col("off") + F.col("s") * SHORT).alias("off"), F.slice("w", F.col("s") * SHORT + 1, F.lit(SHORT + more)).alias("w"))
    first = F.when(F.col("off") == 0, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
    spots = [first]
    for n in sizes:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.least(F.lit(SHORT), F.size("w") - n + 1))).otherwise(F.array().cast("array<int>"))
        spots.append(places(starts, n))
    rows = cut.withColumn("spots", F.concat(*spots)).select(*keep, "n_words", "off", "w", F.explode_outer("spots").alias("spot"))
    rows = rows.select(*keep, "n_words", "off", "w", F.col("spot.at").alias("at"), F.col("spot.n").alias("n")).where("n IS NOT NULL")
    rows = rows.withColumn("hash", F.when(F.col("n") > 0, F.xxhash64(F.slice("w", F.col("at"), F.col("n")))).otherwise(F.lit(0).cast("long")))
    met = rows.join(table, ["n", "hash"])
    same = (F.col("n") == 0) | (F.slice("w", F.greatest("at", F.lit(1)), F.col("n")) == F.col("words"))
    return met.where(same).select(*keep, "n_words", (F.col("off") + F.col("at")).alias("at"), "n", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_words: the positions (from 1) of hit words."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    found = hits(rows, items, size, "__text", ["__row", "doc_id"])
    per = found.groupBy("__row", "doc_id", "n_words").agg(F.collect_set(F.when(F.col("n") > 0, F.struct("at", "n"))).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))  # bounded by the document
    out = per.withColumn("hit_words", hit)
    return out.select("doc_id", F.col("n_words").cast("long"), F.size("hit_words").cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"), "hit_words")


def remove(docs: DataFrame, items: DataFrame, size: int = 10, how: str = "document", key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """docs without contamination: how="document" drops documents with a hit, how="span" blanks the hit words of their texts.

    The decision for a row is made from its own text and joined back by (id, text digest), for dirty rows only."""
    if how not in ("document", "span"):
        raise ValueError(how)
    digest, clean_text = fresh(docs, "digest", "clean")
    named = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = named.select(F.col(digest).alias("__digest"), F.col(text).alias("__text"))
    found = hits(rows, items, size, "__text", ["__digest"]).where("n > 0")
    if how == "document":
        dirty = materialize(found.select(F.col("__digest").alias(digest)).distinct(), "dirty")
        if dirty.count() <= most:  # else texts are dealt out by digest
            dirty = F.broadcast(dirty)
        return named.join(dirty, digest, "left_anti").select(*docs.columns)
    # Dirty texts as rows of a word and the gap after it, so that each word meets its hit by a join; a text's rows make it again.
    hit = found.select("__digest", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at")).distinct().withColumn("__hit", F.lit(True))
    dirty = rows.dropDuplicates(["__digest"]).join(found.select("__digest").distinct(), "__digest", "left_semi")
    any_case = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words, gaps = F.regexp_extract_all(F.col("__text"), F.lit(any_case), F.lit(0)), F.split(F.col("__text"), any_case, -1)
    parts = dirty.select("__digest", F.element_at(gaps, 1).alias("head"), words.alias("w"), gaps.alias("g"))
    parts = parts.select("__digest", "head", F.posexplode(F.arrays_zip("w", F.slice("g", F.lit(2), F.size("w")).alias("after"))).alias("at", "x"))
    kept = parts.withColumn("at", F.col("at") + 1).join(hit, ["__digest", "at"], "left")
    piece = F.concat(F.when(F.col("__hit"), F.lit("")).otherwise(F.col("x.w")), F.col("x.after"))
    clean = kept.groupBy("__digest", "head").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("all"))
    clean = clean.select("__digest", F.concat("head", F.array_join(F.transform("all", lambda p: p["p"]), "")).alias("__clean"))
    clean = clean.select(F.col("__digest").alias(digest), F.col("__clean").alias(clean_text))
    return named.join(clean, digest, "left").withColumn(text, F.coalesce(clean_text, F.col(text))).select(*docs.columns)
