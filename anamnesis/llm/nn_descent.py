"""Operator 8: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt by a hash to shards of about SHARD nodes. NN-descent runs over all shards
at once: each round is a join of the edges with themselves on the common neighbour (neighbours of neighbours), and the
pairs that it gives meet the vectors of their shard, where each node keeps its WIDTH nearest. A query walks the graph of
every shard greedily with a beam; the best over all shards are expanded to the rows that hold the vectors. Queries come in
blocks, so that neither a shard nor a block of queries grows with the data.

Defined results: vectors null, zero or with null or non-finite components, and rows without an id, take no part, neither as queries
nor as candidates; vectors meet those of their own length only; rows that repeat an id count once, with one of
their vectors if they differ;
with fewer than k candidates all are returned; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.llm.common import materialize

SHARD, WIDTH, ROUNDS, BEAM, QUERIES = 4096, 20, 4, 256, 2048


def near_order(X: np.ndarray, rng: np.random.Generator, times: int, reach: int) -> np.ndarray:
    """(pairs, 2): neighbours in the order of random projections."""
    out = []
    for _ in range(times):
        order = np.argsort(X @ rng.standard_normal(X.shape[1]).astype(np.float32))
        for r in range(1, reach + 1):
            if len(order) > r:
                out.append(np.stack([order[:-r], order[r:]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def squared(X: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    out = np.empty(len(a), np.float32)
    for at in range(0, len(a), step):
        d = X[a[at : at + step]] - X[b[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(X: np.ndarray, pairs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the `width` nearest of each node among the pairs, both ways."""
    n = len(X)
    low, high = pairs.min(axis=1), pairs.max(axis=1)
    code = np.unique(low[low != high].astype(np.int64) * n + high[low != high])
    a, b = code // n, code % n
    d = squared(X, a, b)
    a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - first[a]
    keep = rank < width
    return a[keep], b[keep]


def adjacency(n: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """(n, most) neighbours both ways, -1 where there are fewer; forward edges first."""
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, np.arange(n))[src]
    out = np.full((n, most), -1, np.int32)
    keep = rank < most
    out[src[keep], rank[keep]] = dst[keep]
    return out


def greedy(q: np.ndarray, X: np.ndarray, norms: np.ndarray, adj: np.ndarray, entry: np.ndarray, beam: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) that a beam search from the entries ends with."""
    seen = np.zeros(len(X), bool)
    seen[entry] = True
    ids, d = entry, norms[entry] - 2 * (X[entry] @ q)
    done = np.zeros(len(ids), bool)
    while True:
        order = np.argsort(d, kind="stable")[:beam]
        ids, d, done = ids[order], d[order], done[order]
        todo = np.flatnonzero(~done)[:step]
        if not len(todo):
            return ids, d
        done[todo] = True
        new = adj[ids[todo]].ravel()
        new = np.unique(new[new >= 0])
        new = new[~seen[new]]
        seen[new] = True
        ids, d, done = np.concatenate([ids, new]), np.concatenate([d, norms[new] - 2 * (X[new] @ q)]), np.concatenate([done, np.zeros(len(new), bool)])


def nodes_of(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows: id, h1, h2; nodes: h1, h2, node, vec, dim)."""
    v = F.col("v")
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    good = good.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    good = good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    good = good.groupBy("id").agg(F.min(F.struct("h1", "h2", "v")).alias("x")).select("id", "x.*")
    nodes = good.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("v").alias("vec")).withColumn("dim", F.size("vec"))
    return good.select("id", "h1", "h2"), nodes


def build(nodes: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Edges (shard, a, b) of the graph; a and b are positions of nodes in their shard. nodes: shard, pos, vec."""

    def start(key, frame):
        import pandas as pd

        frame = frame.sort_values("pos")
        X = np.stack(frame.vec.to_numpy()).astype(np.float32)
        a, b = nearest(X, near_order(X, np.random.default_rng(3), 4, 12), width)
        return pd.DataFrame({"shard": key[0], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    def descend(key, pairs, frame):
        import pandas as pd

        frame = frame.sort_values("pos")
        if not len(frame):
            return pd.DataFrame({"shard": [], "a": [], "b": []})
        X = np.stack(frame.vec.to_numpy()).astype(np.float32)
        a, b = nearest(X, np.stack([pairs.a.to_numpy(np.int64), pairs.b.to_numpy(np.int64)], axis=1) if len(pairs) else np.empty((0, 2), np.int64), width)
        return pd.DataFrame({"shard": key[0], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    schema = "shard long, a int, b int"
    edges = materialize(nodes.select("shard", "pos", "vec").groupBy("shard").applyInPandas(start, schema), "graph")
    for _ in range(rounds):
        # A node that is near to many lends itself as a common neighbour for as many of them as it has neighbours of its own.
        back = edges.select("shard", F.col("b").alias("a"), F.col("a").alias("b")).withColumn("at", F.row_number().over(W.partitionBy("shard", "a").orderBy(F.xxhash64("a", "b")))).where(F.col("at") <= width).drop("at")
        both = materialize(edges.unionByName(back).distinct(), "both")
        hop = both.select("shard", F.col("a").alias("mid"), F.col("b").alias("a")).join(both.select("shard", F.col("a").alias("mid"), "b"), ["shard", "mid"]).where("a < b").select("shard", "a", "b")
        pairs = hop.unionByName(edges)
        edges = materialize(pairs.groupBy("shard").cogroup(nodes.select("shard", "pos", "vec").groupBy("shard")).applyInPandas(descend, schema), "graph")
    return edges


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, n_shards: int, k: int, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """(query, node, d): the k nearest nodes that the graph of each shard gives, by distance in double precision. queries: query, vec, dim."""
    n_blocks = max(1, -(-queries.count() // QUERIES))

    def run(key, asked, frame, graph):
        import pandas as pd

        empty = pd.DataFrame({"query": np.empty(0, np.int64), "node": np.empty(0, np.int64), "d": np.empty(0)})
        if not len(frame) or not len(asked):
            return empty
        frame = frame.sort_values("pos")
        exact = np.stack(frame.vec.to_numpy())
        X, ids = exact.astype(np.float32), frame.node.to_numpy()
        norms = np.einsum("ij,ij->i", X, X)
        adj = adjacency(len(X), graph.a.to_numpy(np.int64), graph.b.to_numpy(np.int64), 3 * width)
        entry = np.unique(np.linspace(0, len(X) - 1, min(len(X), 64)).astype(np.int64))
        out = []
        for query, vec in zip(asked["query"], asked["vec"], strict=True):
            at, _ = greedy(np.asarray(vec, np.float32), X, norms, adj, entry, beam)
            at = at[: 2 * k + 16]
            d = np.sqrt(((exact[at] - vec) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], d))[:k]
            out.append(pd.DataFrame({"query": query, "node": ids[at][best], "d": d[best]}))
        return pd.concat(out)

    asked = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    asked = asked.join(nodes.select("shard", "dim").distinct(), "dim").select("shard", "block", F.lit(0).alias("kind"), "query", "vec", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("b"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block")
    held = nodes.select("shard", blocks, F.lit(1).alias("kind"), F.col("node").alias("query"), "vec", "pos", F.lit(None).cast("int").alias("b"))
    graph = edges.select("shard", blocks, F.lit(2).alias("kind"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<double>").alias("vec"), F.col("a").alias("pos"), "b")

    def one(key, frame):
        kinds = [frame[frame.kind == i] for i in range(3)]
        return run(key, kinds[0], kinds[1].rename(columns={"query": "node"}), kinds[2].rename(columns={"pos": "a"}))

    return asked.unionByName(held).unionByName(graph).groupBy("shard", "block").applyInPandas(one, "query long, node long, d double")


def neighbours(rows: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    good, nodes = nodes_of(rows, key, vector)
    good = materialize(good, "rows")
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    n_shards = max(1, -(-n // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(n_shards)) + F.col("dim").cast("long") * (1 << 40))
    dealt = materialize(dealt.withColumn("pos", F.row_number().over(W.partitionBy("shard").orderBy("node", "h1", "h2")) - 1), "dealt")
    edges = build(dealt, rounds=rounds)
    # A query is a vector; rows that share it ask once.
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    wanted = asked.select("h1", "h2").distinct().join(nodes, ["h1", "h2"]).select(F.col("node").alias("query"), "vec", "dim")
    own = wanted.select("query", F.col("query").alias("node"), F.lit(0.0).alias("d"))
    found = search(dealt, edges, materialize(wanted, "queries"), n_shards, k + 1, beam).unionByName(own)
    best = found.groupBy("query", "node").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("d", "node"))).where(F.col("r") <= k + 1).drop("r")
    # Of a vector that many rows hold, the k + 1 smallest ids can matter.
    members = good.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "id").withColumn("m", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("m") <= k + 1).drop("m")
    best = materialize(best, "best")
    lists = best.join(materialize(members, "members"), "node").withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("d", "id"))).where(F.col("r") <= k + 1)
    near = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("near"))  # k + 1 at most
    ids = asked.join(nodes.select("h1", "h2", F.col("node").alias("query")), ["h1", "h2"]).select(F.col("id").alias("query_id"), "query").join(near, "query")
    kept = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = ids.select("query_id", F.posexplode(kept).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("score"))
