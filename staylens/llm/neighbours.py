"""Approximate nearest neighbours by cosine with robust-pruned directed graphs, one per shard.

Equal vectors are one node that stands for the smallest ids that any answer can need. Nodes are dealt to shards of bounded
size. In each shard a graph is built in rounds: greedy searches from the shard's medoid propose neighbours, relaxed
distance pruning keeps edges of diverse directions, back edges are added and pruned alike. Searches run for many
points at once, one hop of all of them per step. The graphs are stored; queries, in blocks, are searched in every shard
by beam search, and the best of all shards are scored again in double precision on the vectors as they are given.

The result is approximate only in which nodes a beam meets; scores and order are exact. Recall is measured in the tests.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, as queries or as candidates;
vectors of another length than the query's are no candidates of it. Rows without an id take no part; repeated ids with
equal vectors are one, with different vectors each is a candidate of its own but never of its own id. Ties go to the
smaller id. With fewer candidates than asked for, all are returned. An empty table gives an empty result. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.scan import map_batches
from staylens.llm.stored import Scratch

K = 5
# Nodes in a shard; bounds the memory of a task. Queries in a block.
SHARD_NODES, QUERY_BLOCK = 4_000, 512
DEGREE, BEAM, ALPHA = 24, 48, 1.2
# Beam of a search; wider than the one that builds.
SEARCH_BEAM = 80


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def beam_search(unit: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes met, nearest first, and their distances (1 - cosine); -1 where none.

    Every step expands, for all queries at once, the nearest node of the beam that is not expanded yet.
    """
    n, width = len(queries), edges.shape[1]
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(unit)), bool)
    ids[:, 0], open_[:, 0] = start, True
    far[:, 0] = 1 - queries @ unit[start]
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        first = np.where(open_[live], far[live], np.inf).argmin(axis=1)
        at = ids[live, first]
        open_[live, first] = False
        near = edges[at]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        safe = np.where(fresh, near, 0)
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[row, col] = 1 - np.einsum("ij,ij->i", queries[live[row]], unit[near[row, col]])
        all_d = np.concatenate((far[live], d), axis=1)
        all_ids = np.concatenate((ids[live], np.where(fresh, safe, -1)), axis=1)
        all_open = np.concatenate((open_[live], fresh), axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(live))[:, None]
        far[live], ids[live], open_[live] = all_d[pick, keep], all_ids[pick, keep], all_open[pick, keep] & np.isfinite(all_d[pick, keep])
        live = live[open_[live].any(axis=1)]
    return ids, far


def robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each point: the nearest candidate, then again the nearest one that no kept one is ``alpha`` times
    closer to than the point itself. Candidates of -1 or equal to the point are none."""
    n, c = candidates.shape
    bad = (candidates < 0) | (candidates == points[:, None])
    vectors = unit[np.maximum(candidates, 0)]
    d = 1 - np.einsum("ij,ikj->ik", unit[points], vectors)
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(n)[:, None]
    d, candidates, vectors = d[rows, order], candidates[rows, order], vectors[rows, order]
    again = np.zeros((n, c), bool)
    again[:, 1:] = (candidates[:, 1:] == candidates[:, :-1]) & np.isfinite(d[:, 1:])
    alive = np.isfinite(d) & ~again
    out = np.full((n, degree), -1, np.int64)
    for slot in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = np.where(some)[0]
        first = alive[at].argmax(axis=1)
        out[at, slot] = candidates[at, first]
        between = 1 - np.einsum("ij,ikj->ik", vectors[at, first], vectors[at])
        alive[at] &= alpha * between > d[at]
        alive[at, first] = False
    return out


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (nodes x degree, -1 where none) and the node where searches start."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    start = int((unit @ unit.mean(axis=0)).argmax())
    edges = np.full((n, degree), -1, np.int64)
    if n <= degree + 1:
        for i in range(n):
            others = np.delete(np.arange(n), i)
            edges[i, : len(others)] = others
        return edges, start
    edges[:] = rng.integers(0, n, (n, degree))
    for a in (1.0, alpha):
        for at in np.array_split(rng.permutation(n), -(-n // batch)):
            met, _ = beam_search(unit, edges, start, unit[at], beam)
            edges[at] = robust_prune(unit, at, np.concatenate((met, edges[at]), axis=1), degree, a)
            # Back edges: a node gets those that chose it, and is pruned again.
            source = np.repeat(at, degree)
            target = edges[at].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            most = min(int(count.max()), 4 * degree)
            extra = np.full((len(nodes), most), -1, np.int64)
            place = np.arange(len(target)) - np.repeat(first, count)
            ok = place < most
            extra[np.repeat(np.arange(len(nodes)), count)[ok], place[ok]] = source[ok]
            edges[nodes] = robust_prune(unit, nodes, np.concatenate((edges[nodes], extra), axis=1), degree, a)
    return edges, start


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec as array<double>) of the rows that take part."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nodes_of(usable: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with the k + 1 smallest ids that have it, which is all that any answer can need."""
    w = Window.partitionBy("vec").orderBy("id")
    few = usable.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """One row per shard and vector length: vectors, ids and edges of its graph."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        vec = rows["vec"].combine_chunks()
        dim = key[1].as_py()
        vectors = vec.flatten().to_numpy().reshape(len(rows), dim)
        edges, start = build_graph(_unit(vectors))
        out = {
            "shard": [key[0].as_py()], "dim": [dim], "start": [start],
            "vectors": [vectors.astype("<f8").tobytes()], "edges": [edges.astype("<i4").tobytes()], "ids": [rows["ids"].to_pylist()],
        }
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("start", pa.int32()), ("vectors", pa.binary()), ("edges", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    dealt = nodes.withColumns({"shard": F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"), "dim": F.size("vec")})
    return dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, start int, vectors binary, edges binary, ids array<array<long>>")


def search(df: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows of ``df`` by cosine for each row of ``queries``."""
    scratch = Scratch(df.sparkSession, "neighbours")
    nodes = scratch.put(nodes_of(_usable(df, vec_id, vector), k))
    shards = max(1, -(-nodes.count() // SHARD_NODES))
    built = scratch.put(graphs(nodes, shards))
    asked = _usable(queries, vec_id, vector).distinct().withColumn("dim", F.size("vec"))
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK))))
    # The stated query set, block by block, goes to every shard.
    grouped = asked.groupBy("dim", blocks.alias("block")).agg(F.collect_list("id").alias("qids"), F.flatten(F.collect_list("vec")).alias("qvecs"))
    pairs = built.join(grouped, "dim").repartition("shard", "block").select("dim", "start", "vectors", "edges", "ids", "qids", "qvecs")

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            dim, start, vectors, edges, ids, qids, qvecs = (c[i] for c in batch.columns)
            dim = dim.as_py()
            base = np.frombuffer(vectors.as_py(), "<f8").reshape(-1, dim)
            links = np.frombuffer(edges.as_py(), "<i4").reshape(len(base), -1).astype(np.int64)
            own = ids.as_py()
            q_ids = qids.values.to_numpy()
            q = qvecs.values.to_numpy().reshape(-1, dim)
            met, _ = beam_search(_unit(base), links, start.as_py(), _unit(q), beam)
            rows = []
            for j, q_id in enumerate(q_ids.tolist()):
                at = met[j][met[j] >= 0]
                score = cosines(q[j], base[at])
                found = [(-s, v) for s, a in zip(score.tolist(), at.tolist()) for v in own[a] if v != q_id]
                rows += [(q_id, v, -s) for s, v in sorted(found)[:k]]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = map_batches(pairs, over, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosines(query: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row, in double precision; largest components are scaled to 1 against overflow."""
    a = query / np.abs(query).max()
    b = base / np.abs(base).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
