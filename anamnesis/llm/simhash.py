"""Operator 6: SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split so that a close pair has equal blocks, rows meet in joins on blocks, pairs are verified by
Hamming distance, and links become components. Equal fingerprints count once.

`linked` is exact: 64 bits in four blocks; a pair within two bits has two equal blocks of the four, so six keys of
32 bits find it. Buckets of more than HOT fingerprints give no pairs; their members meet at midpoints instead: two
fingerprints within two bits share a fingerprint within one bit of each, no midpoint has more than 65 neighbours,
and all neighbours of a midpoint are within two bits of each other. So no bucket is capped or skipped.

`near_duplicates` links texts whose sets of five-word shingles have a similarity of 0.8 or more, exactly. Its first links are those of
the method: fingerprints of these shingles meet on blocks, those within two bits are candidates, and an exact check of the two
sets follows. Similar texts whose fingerprints are further apart, which 64 bits cannot tell, come from the shingles themselves (prefix
filter), as far as the first links have left them apart; every link is decided by the two sets. Members of crowded buckets meet
pivots before each other; what pivots leave apart meets in cells, so no bucket is capped or skipped there either. Shingles that
only one text has are dropped first. What is left is taken in slices and pairs in parts, one after the other, so that disk is needed for one at a
time; both grow with the input, and the texts are read once for all parts, so their number doesn't.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked like any
other; null ids keep their rows and take the component of their fingerprint (null if it has no id at all); repeated
rows are in one component; an empty table gives no row. Further columns are ignored by `linked` and kept by
`drop_near_duplicates`, which keeps one row of each group.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.llm.common import Memory, discard, fresh, materialize, settle, small_batches
from anamnesis.llm.components import components

#: Members of a bucket that are still paired with each other.
HOT = 64


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; of the whole sequence if it is shorter."""
    return hashed(words_of(text), words)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashed(w: list[bytes], words: int) -> np.ndarray:
    import xxhash

    if not w:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]  # noqa: B905
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, 42) for p in parts), np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of h (uint64, one or more columns), as uint64 per column."""
    if not len(h):
        return np.zeros(h.shape[1] if h.ndim > 1 else 1, np.uint64)
    wide = h.reshape(len(h), -1)
    counts = np.zeros(wide.shape[1] * 64, np.int64)
    for at in range(0, len(wide), 255):  # a sum of 255 bits fits a byte
        bits = np.unpackbits(np.ascontiguousarray(wide[at : at + 255]).view(np.uint8), bitorder="little").reshape(-1, len(counts))
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(wide), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash as a long."""

    def run(batches):
        import pyarrow as pa

        Memory.only("simhash")
        for batch in batches:
            fp = np.array([majority(hashes(x.as_py(), words))[0] for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("x")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: str):
    """Six keys of two blocks of 16 bits each, as longs."""
    block = [F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(pairs)))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints within two bits whose components are those of all such pairs. fps: distinct longs `fp`."""
    rows = fps.select("fp", F.explode(block_keys("fp")).alias("key"))
    crowded = materialize(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
    cold = rows.join(crowded, "key", "left_anti") if crowded.head(1) else rows
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    found = a.join(b, "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    if not crowded.head(1):
        return found
    members = rows.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    spots = members.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return found.unionAll(spots.join(least, "spot").where("a <> fp").select("a", F.col("fp").alias("b")))


def linked(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of two bits or fewer)."""
    rows = materialize(fingerprints(docs, words, key, text), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps))
    own = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    own = materialize(own, "roots")
    ids = own.groupBy("root").agg(F.min("first").alias("component_id"))
    per = own.join(ids, "root").select("fp", "component_id")
    return rows.join(per, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by their shingles ---------------------------------------------------------------------------------

#: Members up to which all pairs of a bucket are counted at once; larger buckets meet pivots first.
CROWD = 8
#: Members of a cell, in which what is left of a large bucket is paired.
CELL = 256
#: Keys before each one that go with it, to tell pairs that have met before.
BACK = 4
#: Texts among which common words are looked for, rows from which a word or shingle is common, and shingles kept as common at most.
SAMPLE, COMMON, KNOWN = 4_000, 3, 500_000
#: Of this many texts one is looked at for common shingles: how many texts may share one that isn't known doesn't grow with the input.
ONE_OF = 16
#: Texts to be compared up to which their numbers or short hashes are broadcast, at about 40 bytes each.
ASKED = 1_000_000
#: Shingles that meet at once, at about 75 bytes of shuffle files each, and pairs that are compared at once, at about 10,000. Each slice and
#: part reads tables again, so they grow with the input: to a QUARTER of all shingles looked at, and to one pair for EACH so many texts.
ENTRIES, PAIRS = 8_000_000, 50_000
QUARTER, EACH = 4, 8
#: Against rounding: bounds are taken a little too low, never too high.
SLACK = 1e-9


def written(df: DataFrame, tag: str) -> DataFrame:
    """`materialize`, after which the shuffle files of the job are gone, where Spark can do so (4.1): the rest waits for `settle`."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, tag)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def distinct(h: np.ndarray) -> np.ndarray:
    own = np.unique(h).view(np.int64)
    return own if len(own) else np.zeros(1, np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes as signed longs; texts without words have a set of their own in common."""
    return distinct(hashes(text, words))


def common(named: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """(sorted hashes, how often) of shingles that are common in a sample, and how common its words are (eighths of a power of two): they
    only order shingles, so any sample gives the same groups."""
    few = min(65535, int(65536 * SAMPLE / max(named.count(), 1)))

    def run(batches):
        import pyarrow as pa

        Memory.only("simhash")
        for batch in batches:
            for x, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                w = words_of(x.as_py())
                own, names = distinct(hashed(w, words)), list(set(w)) if part <= few else []
                yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), *[None] * len(names)], pa.int64()), pa.array([*[None] * len(own), *names], pa.binary())], names=["h", "w"])

    some = named.select("x", F.shiftrightunsigned("mark", 48).alias("part")).where(F.col("part") <= max(few, 65536 // ONE_OF))
    seen = some.mapInArrow(run, "h long, w binary").groupBy("h", "w").count().where(F.col("count") >= COMMON)
    seen = seen.orderBy(F.col("w").isNull(), F.desc("count"), "h").limit(2 * KNOWN).toArrow()
    often, given = seen.column("count").to_numpy(), seen.column("w").is_valid().to_numpy()
    h, n = seen.column("h").filter(~given).to_numpy(), often[~given]
    order = np.argsort(h)
    level = np.ceil(8 * np.log2(often[given])).astype(int).tolist()
    return h[order], n[order], dict(zip(seen.column("w").filter(given).to_pylist(), level, strict=True))


def ordered(text: str | None, words: int, known: tuple[np.ndarray, np.ndarray, dict[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, repeats included, and the distinct ones, rare ones first: those that are common in the sample go last, and others by
    how common their words are, so that what meets by chance among ever more texts stays behind."""
    keys, often, level = known
    w = words_of(text)
    h = hashed(w, words)
    if not len(h):
        return h, distinct(h)
    sums = np.cumsum(np.fromiter(chain((0,), map(level.get, w, repeat(0))), np.int64, len(w) + 1))
    own, at = np.unique(h, return_index=True)
    rank = (sums[words:] - sums[:-words])[at] if len(w) >= words else sums[-1:]
    own = own.view(np.int64)
    if len(keys):
        where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        rank = rank + np.where(keys[where] == own, often[where] << 32, 0)
    return h, own[np.argsort(rank, kind="stable")]


def shingled(named: DataFrame, words: int, least: float, known: tuple[np.ndarray, np.ndarray, dict[bytes, int]]) -> DataFrame:
    """Rows with the SimHash fp and the number n of their shingles and the first of these in an order that all texts share (rare ones
    first): of two sets with a similarity of `least`, the first n - ceil(least * n) + 1 have a member in common."""

    def run(batches):
        import pyarrow as pa

        Memory.only("simhash")
        for batch in batches:
            fps, sizes, first = [], [], []
            for x in batch.column(3):
                h, s = ordered(x.as_py(), words, known)
                first.append(s[: len(s) - int(np.ceil(least * len(s) - SLACK)) + 1])
                sizes.append(len(s))
                fps.append(majority(h)[0])
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fp, pa.array(sizes, pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "cls", "mark", "fp", "n", "first"])

    small_batches(named.sparkSession)
    return named.select("doc_id", "cls", "mark", "x").mapInArrow(run, "doc_id long, cls string, mark long, fp long, n long, first array<long>")


def parts(pairs: DataFrame, most: int) -> list[DataFrame]:
    """The pairs, written, in parts of about `most`."""
    count = max(1, -(-pairs.count() // most))
    return [pairs.where(F.pmod(F.xxhash64("a"), F.lit(count)) == i) for i in range(count)] if count > 1 else [pairs]


def among(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of nodes that are in a pair."""
    asked = written(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    return nodes.join(F.broadcast(asked) if asked.count() <= ASKED else asked, "node", "left_semi")


def texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, x): the texts of the wanted (node, cls, mark), written, in one scan. They are found by their short hash `mark`, and the digest decides."""
    texts, marks = named.select("x", "mark"), wanted.select("mark").distinct()
    if wanted.count() <= ASKED:
        texts = texts.join(F.broadcast(marks), "mark", "left_semi")
    met = texts.join(wanted.hint("shuffle_merge"), "mark").where(digest("x") == F.col("cls"))
    return written(met.groupBy("node").agg(F.first("x").alias("x")), "wanted")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, set) of (node, x): worked out from the texts again, as sets of all texts would take more room than the texts."""

    def run(batches):
        import pyarrow as pa

        Memory.only("simhash")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), words) for x in batch.column(1)], pa.list_(pa.int64()))], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def verified(pairs: DataFrame, named: DataFrame, classes: DataFrame, words: int, least: float, most: int) -> DataFrame:
    """The pairs (a, b) whose sets are at least that similar, written, `most` at once. pairs: written; classes: node, cls, mark."""
    if not pairs.head(1):
        return pairs.select("a", "b")
    wanted = written(among(classes, pairs), "asked")
    texts = texts_of(named, wanted)
    discard(wanted)
    out, some_of = [], parts(pairs, most)
    for some in some_of:
        sets = written(sets_of(among(texts, some) if len(some_of) > 1 else texts, words), "sets")
        for c in "ab":
            some = some.join(sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")), c)
        both = F.size(F.array_intersect("a_set", "b_set"))
        out.append(written(some.where(both / (F.size("a_set") + F.size("b_set") - both) >= least).select("a", "b"), "links"))
        discard(sets)
    discard(texts)
    return reduce(DataFrame.unionAll, out)


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, root) of the components after the links; None: none has been found so far."""
    if not links.head(1):
        return roots
    new = components(links if roots is None else links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    if roots is not None:
        discard(roots)
    return new


def rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of nodes with their root, which is the node itself if nothing links it."""
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def close(classes: DataFrame) -> DataFrame:
    """(a, b), written: texts whose fingerprints are within two bits. Equal fingerprints meet their first text, and these meet for the links of
    fingerprints. classes: node, fp."""
    fps = written(classes.groupBy("fp").agg(F.min("node").alias("first")), "distinct")
    same = classes.join(fps, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(fps.select("fp"))
    for c in "ab":
        near = near.join(fps.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")), c)
    out = written(same.unionAll(near.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))).distinct(), "close")
    discard(fps)
    return out


def needed(m: Column, n: Column, least: float) -> Column:
    """Shingles that sets of m and n must have in common."""
    return F.ceil(least / (1 + least) * (m + n) - SLACK)


def likely(pairs: DataFrame, prefixes: DataFrame, least: float, most: int) -> DataFrame:
    """The pairs (a, m, b, n) that share keys enough for their sizes, if what follows the first keys were all in common; written. prefixes: node, first."""
    out = []
    for some in parts(pairs, most):
        ends = among(prefixes, some)
        for c in "ab":
            some = some.join(ends.select(F.col("node").alias(c), F.col("first").alias(f"{c}_first")), c)
        shared = F.size(F.array_intersect("a_first", "b_first"))
        some = some.where(shared + F.ceil(least * F.greatest("m", "n") - SLACK) - 1 >= needed(F.col("m"), F.col("n"), least))
        out.append(written(some.select("a", "b"), "likely"))
    all_of = written(reduce(DataFrame.unionAll, out), "likely")
    discard(*out)
    return all_of


def met(texts: DataFrame) -> DataFrame:
    """(key, node, at, size), written: the keys that two texts or more have, and how many. Only numbers are dealt out for it. texts: node, first."""
    rows = texts.select("node", F.posexplode("first").alias("at", "key"))
    return written(rows.withColumn("size", F.count("*").over(W.partitionBy("key"))).where("size > 1"), "met")


def candidates(entries: DataFrame, prefixes: DataFrame, verify, least: float, roots: DataFrame | None, hot: int = CROWD, rounds: int = 2) -> DataFrame | None:
    """(node, root): the components of all similar pairs that share a key of entries, on top of those in `roots`. entries: key, node, n, at (place
    of the key in the text's order, from 0), prev (the BACK keys before it), size (texts with that key); prefixes: node, first; verify: from
    pairs (a, b) to the similar ones, written.

    Exact. Texts meet in the bucket of each key, and a pair has to be seen in that of its first common key only. There both keys stand
    so far ahead that what follows them can still be common enough for the two sizes, which `ahead` tests; and if the BACK keys before
    them have one in common, the pair has met before, maybe in another slice. All members of a bucket of more than `hot` are compared with
    its pivot, the member with most in common with others, which then leaves; buckets within one component are settled. After `rounds` rounds the
    pairs of different components that are left in a bucket meet, in cells. Pairs are compared unless the number of keys they
    share (all their common ones, or they have been compared) is too small for their sizes."""

    def ahead(x: str, y: str):
        m, n = F.col(f"{x}n"), F.col(f"{y}n")
        return (F.col(f"{x}at") <= m - needed(m, n, least)) & (F.col(f"{y}at") <= n - needed(m, n, least)) & (F.least(m, n) >= least * F.greatest(m, n) - SLACK)

    spark = entries.sparkSession
    most = max(4 * PAIRS, prefixes.count() // 2)
    own = written(entries, "entries")
    score = own.groupBy("node").agg((F.sum(F.log2("size")) / F.first("n")).alias("score"))
    now = rooted(own.drop("size").join(score, "node"), roots)
    before = [own]
    for turn in range(rounds + 1):
        state = now.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("score", "node", "n", "at", "root")).alias("p"))
        now = written(now.join(state.where("lo <> hi").drop("lo", "hi"), "key"), "open")
        discard(*before)
        settle(spark)
        before = [now]
        crowded = now.where(F.col("size") > hot)
        if turn == rounds or not crowded.head(1):
            break
        asked = crowded.where("root <> p.root").where(ahead("", "p."))
        swap = F.col("node") > F.col("p.node")
        asked = asked.select(F.least("node", "p.node").alias("a"), F.when(swap, F.col("p.n")).otherwise(F.col("n")).alias("m"), F.greatest("node", "p.node").alias("b"), F.when(swap, F.col("n")).otherwise(F.col("p.n")).alias("n"))
        asked = written(asked.distinct(), "pivots")
        close = likely(asked, prefixes, least, most)
        roots = joined(roots, verify(close))
        discard(asked, close)
        now = now.where((F.col("size") <= hot) | (F.col("node") != F.col("p.node"))).select("key", "node", "n", "at", "prev", "score")
        now = rooted(now, roots)
    cells = F.ceil(F.col("size") / CELL).cast("int")
    own = ["key", "node", "n", "at", "prev", "root"]
    rest = now.select(*own, cells.alias("cells"), F.pmod(F.xxhash64("node"), cells).cast("int").alias("cell"))
    rest = rest.select(*own, "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    rest = rest.select(*own, F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell")
    x, y = rest.alias("x"), rest.alias("y")
    # A cell off the diagonal is for pairs of its two parts.
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.cell") != F.col("y.cell")) | (F.col("i") == F.col("j")))
    first = ahead("x.", "y.") & ~F.arrays_overlap("x.prev", "y.prev")
    pairs = x.join(y, ["key", "i", "j"]).where(apart & first).select(F.col("x.node").alias("a"), F.col("x.n").alias("m"), F.col("y.node").alias("b"), F.col("y.n").alias("n")).distinct()
    pairs = written(pairs, "pairs")
    discard(now)
    asked = likely(pairs, prefixes, least, most)
    discard(pairs)
    roots = joined(roots, verify(asked))
    discard(asked)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cls, component_id, stays): one row per distinct (doc_id, text); component_id is the smallest doc_id of the group.

    Equal texts are one node. stays marks one (doc_id, text) of each group."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("cls"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("x"))
    small_batches(docs.sparkSession)
    # One row of each text is kept, on the way to disk.
    rows = shingled(named, words, least, common(named, words)).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("mark", "fp", "n", "first")).alias("s"))
    texts = written(rows.select(F.monotonically_increasing_id().alias("node"), "cls", "doc_id", "s.*"), "texts")
    count, keys = texts.agg(F.count("*"), F.coalesce(F.sum(F.size("first")), F.lit(0))).first()
    most = max(PAIRS, count // EACH)

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, named, texts.select("node", "cls", "mark"), words, least, most)

    pairs = close(texts.select("node", "fp"))
    roots = joined(None, verify(pairs))
    discard(pairs)
    shared = met(texts.select("node", "first"))
    back = F.slice("first", F.greatest(F.lit(1), F.col("at") - BACK + 1), F.least(F.lit(BACK), F.col("at")))
    slices = max(1, -(-shared.count() // max(ENTRIES, keys // QUARTER)))
    for i in range(slices):
        some = shared.where(F.pmod("key", F.lit(slices)) == i) if slices > 1 else shared
        some = some.join(texts.select("node", "n", "first"), "node").select("key", "node", "n", "at", back.alias("prev"), "size")
        roots = candidates(some, texts.select("node", "first"), verify, least, roots)
        settle(docs.sparkSession)
    discard(shared)
    own = written(rooted(texts.select("cls", "node", F.col("doc_id").alias("first")), roots).select("cls", "root", "first"), "roots")
    discard(texts)
    group = own.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "cls")).alias("kept"))
    per = own.join(group, "root").select("cls", F.col("kept.first").alias("component_id"), F.col("kept.cls").alias("kept"))
    ids = written(named.select("doc_id", "cls").distinct(), "ids")
    settle(docs.sparkSession)
    return ids.join(per, "cls").select("doc_id", "cls", "component_id", (F.col("cls").eqNullSafe(F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))


def digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs, whatever their names."""
    at, rank = fresh(docs, "at", "rank")
    stay = near_duplicates(docs, words, least, key, text).where("stays")
    stay = written(stay.select(F.concat_ws("-", "cls", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(at)), "stay")
    # Texts are dealt out by digest and id, once for the join and the choice among repeated rows.
    named = docs.withColumn(at, F.concat_ws("-", digest(text), F.coalesce(F.col(key).cast("long").cast("string"), F.lit("null"))))
    met = named.join(stay, at, "left_semi")
    return met.withColumn(rank, F.row_number().over(W.partitionBy(at).orderBy(at))).where(F.col(rank) == 1).drop(at, rank)
