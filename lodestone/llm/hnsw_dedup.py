"""Embedding near-dedup by hierarchical navigable small-world graphs, one for each shard.

Vectors that are the same are one class. The classes of a label are dealt into shards of bounded
size; each shard builds a graph, and every class queries the graphs of all shards of its label. A
query widens its beam by all hits it meets, so that the beam reaches below the threshold, and a block of
queries widens all its beams until an audit against exhaustive search meets the wanted recall a query, in
dense groups and outside of them. The audit asks for a sample of the block and for planted vectors that
lie just above the threshold of some node, so it has true links in every block; it only measures, and all
links come from the graph. Hits are verified by cosine in double precision. Each block counts each query's
links and keeps a spanning forest of them, so what leaves it is linear in its size, however dense a group is.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import hot_join, read, written
from lodestone.llm.components import components

THRESHOLD = 0.98
SHARD = 16_384
BLOCK = 8_192
#: Blocks that one copy of a graph serves, so that the queries it meets are more bytes than it is.
LANE = 4
RECALL = 0.995
#: Queries of a block that are audited: one in AUDIT, 16 at least; beside them PLANTED vectors made from the shard's own.
AUDIT = 32
PLANTED = 64
#: Queries with more links than this are of a dense group.
SPARSE = 12
LINKS = 8
BUILD_BEAM = 40
BEAM = 12


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; similarity is the inner product.

    A node keeps its link to and from the nearest node that it met when it came (`up`), whatever else is pruned. So
    pruning cuts no islands out of dense groups.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 1) -> None:
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        levels = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry = -1
        self.up = np.arange(n)
        self._flat: np.ndarray | None = None
        for i in range(n):
            self._insert(i, int(levels[i]))

    def _search(self, q: np.ndarray, starts: list[int], beam: int, links: dict[int, np.ndarray]) -> list[tuple[float, int]]:
        """The beam's best nodes, best first."""
        x = self.x
        seen = set(starts)
        near = [(float(x[s] @ q), s) for s in starts]
        todo = [(-s, i) for s, i in near]
        heapq.heapify(near)
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if len(near) >= beam and -s < near[0][0]:
                break
            fresh = [j for j in links[i].tolist() if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, j in zip((x[fresh] @ q).tolist(), fresh, strict=True):
                if len(near) < beam:
                    heapq.heappush(near, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > near[0][0]:
                    heapq.heapreplace(near, (s, j))
                    heapq.heappush(todo, (-s, j))
        near.sort(reverse=True)
        return near

    def _choose(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to those already chosen; then the nearest of the rest."""
        ids = [j for _, j in found]
        if len(ids) <= most // 2:
            return np.array(ids, np.int64)
        between = self.x[ids] @ self.x[ids].T
        chosen, left = [], []
        for k, (s, _) in enumerate(found):
            if len(chosen) < most and (not chosen or s > between[k, chosen].max()):
                chosen.append(k)
            else:
                left.append(k)
        return np.array([ids[k] for k in chosen + left[: most - len(chosen)]], np.int64)

    def _insert(self, i: int, level: int) -> None:
        q = self.x[i]
        starts = [self.entry] if self.entry >= 0 else []
        top = len(self.layers) - 1
        for k in range(top, level, -1):
            starts = [self._search(q, starts, 1, self.layers[k])[0][1]]
        for k in range(min(level, top), -1, -1):
            links, most = self.layers[k], LINKS * (2 if k == 0 else 1)
            found = self._search(q, starts, BUILD_BEAM, links)
            links[i] = self._choose(found, most)
            for j in links[i].tolist():
                own = np.append(links[j], i)
                if len(own) > most:
                    s = self.x[own] @ self.x[j]
                    order = np.argsort(-s)
                    own = self._choose([(float(s[o]), int(own[o])) for o in order], most)
                links[j] = own
            starts = [j for _, j in found]
        if i:
            self.up[i] = starts[0]
        for _ in range(top + 1, level + 1):
            self.layers.append({i: np.zeros(0, np.int64)})
            self.entry = i

    def _widened(self, q: np.ndarray, threshold: float, beam: int, found: list[int]) -> list[int]:
        """The hits of a beam that holds all hits it meets and the best `beam` other nodes; many nodes are opened at a time."""
        if self._flat is None:
            size = np.array([len(self.layers[0][i]) for i in range(len(self.x))])
            self._flat = np.full((len(self.x), int(size.max(initial=1))), len(self.x), np.int64)
            for i, n in enumerate(size.tolist()):
                self._flat[i, :n] = self.layers[0][i]
        score = np.full(len(self.x), -np.inf, np.float32)
        opened, now = np.zeros((2, len(self.x)), bool)
        met = np.array(found, np.int64)
        score[met] = self.x[met] @ q
        while True:
            hit = score[met] >= threshold
            todo = met[hit & ~opened[met]]
            if not len(todo):
                others = met[~hit]
                best = others[np.argsort(-score[others])[:beam]]
                todo = best[~opened[best]]
            if not len(todo):
                return met[hit].tolist()
            opened[todo] = now[todo] = True
            linked = np.append(now[self.up], False)
            now[todo] = False
            linked[self._flat[todo]] = linked[self.up[todo]] = True
            fresh = np.flatnonzero(linked[:-1] & (score == -np.inf))
            score[fresh] = self.x[fresh] @ q
            met = np.concatenate([met, fresh])

    def near(self, q: np.ndarray, threshold: float, beam: int) -> list[int]:
        """Nodes that seem to be at the threshold or above; a beam that doesn't reach below grows by the hits it meets."""
        q = q.astype(np.float32)
        starts = [self.entry]
        for k in range(len(self.layers) - 1, 0, -1):
            starts = [self._search(q, starts, 1, self.layers[k])[0][1]]
        found = self._search(q, starts, min(beam, BEAM), self.layers[0])
        if len(found) < min(beam, BEAM):  # what can be reached is less than the beam; the rest is looked at too
            return np.flatnonzero(self.x @ q >= threshold).tolist()
        if found[-1][0] < threshold and beam <= BEAM:
            return [j for s, j in found if s >= threshold]
        return self._widened(q, threshold, beam, [j for _, j in found])

    def dump(self) -> dict[str, np.ndarray]:
        """Links as flat 32-bit arrays; the vectors go apart."""
        out = {"entry": np.array([self.entry]), "up": self.up.astype(np.int32)}
        for k, layer in enumerate(self.layers):
            ids = np.fromiter(layer, np.int32, len(layer))
            out |= {f"ids{k}": ids, f"size{k}": np.array([len(layer[i]) for i in ids.tolist()], np.int32)}
            out[f"to{k}"] = np.concatenate([np.zeros(0, np.int32), *[layer[i].astype(np.int32) for i in ids.tolist()]])
        return out

    @classmethod
    def load(cls, vectors: np.ndarray, state) -> Graph:
        out = cls.__new__(cls)
        out.x, out.entry, out.layers, out._flat = vectors.astype(np.float32), int(state["entry"][0]), [], None
        out.up = state["up"].astype(np.int64)
        while f"ids{len(out.layers)}" in state:
            k = len(out.layers)
            parts = np.split(state[f"to{k}"].astype(np.int64), np.cumsum(state[f"size{k}"])[:-1])
            out.layers.append(dict(zip(state[f"ids{k}"].tolist(), parts, strict=True)))
        return out


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, graph: Graph) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, sizes=sizes, x=x, **graph.dump())
    return out.getvalue()


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    x = _unit(pdf["embedding"])
    return pd.DataFrame({"bin": pdf["bin"][:1], "shard": pdf["shard"][:1], "state": [packed(pdf["cid"].to_numpy(), pdf["n"].to_numpy(), x, Graph(x))]})


class _Links:
    """What a shard's queries were found to link with: their numbers, and a spanning forest of the links."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.root = np.arange(len(ids))
        self.u: list[int] = []
        self.v: list[int | None] = []
        self.n: list[int] = []

    def add(self, own: int, hits: np.ndarray) -> None:
        """Links own with all hits. A hit for each tree that own doesn't touch yet is enough, and joins these trees to one."""
        if not len(hits):
            return
        self.u.append(own)
        self.v.append(None)
        self.n.append(int(self.sizes[hits].sum()))
        roots, first = np.unique(self.root[hits], return_index=True)
        at = int(np.searchsorted(self.ids, own))
        mine = self.root[at] if at < len(self.ids) and self.ids[at] == own else -1
        for root, k in zip(roots.tolist(), first.tolist(), strict=True):
            if root != mine:
                self.u.append(own)
                self.v.append(int(self.ids[hits[k]]))
                self.n.append(0)
        if len(roots) > 1 or mine not in (-1, roots[0]):
            every = np.append(roots, mine) if mine >= 0 else roots
            self.root[np.isin(self.root, every)] = every.min()

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"u": pd.array(self.u, "Int64"), "v": pd.array(self.v, "Int64"), "n": pd.array(self.n, "Int64")})


def _planted(x: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors whose cosine with a node each is a quarter of the way from the threshold to 1."""
    rng = np.random.default_rng(len(x))
    at = x[rng.permutation(len(x))[:PLANTED]].astype(np.float64)
    side = rng.normal(size=at.shape)
    side -= (side * at).sum(axis=1, keepdims=True) * at
    norm = np.sqrt((side * side).sum(axis=1, keepdims=True))
    side = np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9)
    c = threshold + (1 - threshold) / 4
    out = c * at + np.sqrt(1 - c * c) * side
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _beam(q: np.ndarray, graph: Graph, x: np.ndarray, threshold: float, loose: float) -> int:
    """The beam with which the graph finds RECALL of the true links of the audited queries."""
    step = max(1, min(AUDIT, len(q) // 16))
    asked = np.concatenate([q[::step], _planted(x, threshold)])
    truth = [set(np.flatnonzero(x @ a >= threshold).tolist()) for a in asked]
    # Each query counts alike, and those of dense groups apart from the others.
    audits = [[k for k, t in enumerate(truth) if 0 < len(t) <= SPARSE], [k for k, t in enumerate(truth) if len(t) > SPARSE]]
    beam = BEAM
    while beam < len(x):
        recalls = [np.mean([len(truth[k].intersection(graph.near(asked[k], loose, beam))) / len(truth[k]) for k in a]) for a in audits if a]
        if min(recalls, default=1.0) >= RECALL:
            break
        beam *= 2
    return beam


def _query(threshold: float, load=Graph.load):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({"u": [], "v": [], "n": []})
        state = np.load(io.BytesIO(index["state"].iloc[0]))
        ids, x = state["ids"], state["x"]
        graph, links = load(x, state), _Links(ids, state["sizes"])
        loose = threshold - 1e-4  # single precision proposes, double decides
        for _, block in queries.sort_values(["block", "cid"]).groupby("block"):
            q, own = _unit(block["embedding"]), block["cid"].to_numpy()

            def exact(k: int, found) -> np.ndarray:
                found = np.asarray(found, np.int64)
                return found[(x[found] @ q[k] >= threshold) & (ids[found] != own[k])]  # noqa: B023

            beam = _beam(q, graph, x, threshold, loose)
            for k in range(len(q)):
                links.add(int(own[k]), exact(k, graph.near(q[k], loose, beam)))
        return links.rows()

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """Components of vectors with equal labels and cosine >= threshold.

    Returns one row for each row of vectors: vec_id, n_links (other rows linked directly), component_id
    (least vec_id reachable), kept (whether it is this row's). A row whose label or vector is null, or whose vector is empty,
    zero, or holds a null, NaN or infinity links with nothing and is its own component. Vectors of
    different lengths don't link. Rows with the same vector and label always link, repeated ids included. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sane = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0)
    sane = F.coalesce(sane, F.lit(False))
    k1, k2 = F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")
    rows = written(rows.select("vec_id", "label", "embedding", sane.alias("sane"), k1.alias("k1"), k2.alias("k2")), "hnsw-rows")
    good = rows.filter("sane")
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    bins = F.xxhash64("label", F.size("embedding"))
    classes = written(classes.withColumn("bin", bins).withColumn("cid", F.monotonically_increasing_id()), "hnsw-classes")
    sizes = written(classes.groupBy("bin").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "hnsw-bins")
    dealt = classes.join(sizes, "bin")
    of = F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")
    index = dealt.withColumn("shard", of).select("bin", "shard", "cid", "n", "embedding").groupBy("bin", "shard").applyInPandas(_build, "bin long, shard int, state binary")
    index = written(index, "hnsw-index")
    block = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("blocks")).cast("int")
    queries = dealt.select("bin", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"), "cid", "embedding").withColumn("lane", F.floor(F.col("block") / LANE).cast("int"))
    lanes = sizes.select(F.col("bin").alias("of"), F.floor((F.col("blocks") - 1) / LANE).cast("int").alias("lanes"))
    served = index.join(lanes, F.col("bin") == F.col("of")).select(F.col("bin").alias("b"), F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0), F.col("lanes"))).alias("k"), "state")
    found = queries.groupBy("bin", "shard", "lane").cogroup(served.groupBy("b", "s", "k")).applyInPandas(_query(threshold), "u long, v long, n long")
    found = written(found, "hnsw-found")
    labels = written(components(found.filter("v IS NOT NULL").select("u", "v"), "hnsw-components"), "hnsw-labels")
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    heads = classes.select("k1", "k2", "cid", "first", "n").join(links, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    heads = written(heads.withColumn("label", F.coalesce("label", "cid")), "hnsw-heads")
    least = heads.groupBy("label").agg(F.min("first").alias("component_id"))
    heads = heads.join(least, "label").select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    heads = written(heads, "hnsw-classes-out")
    full = hot_join(good, heads, ["k1", "k2"], "n").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sane").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT rid, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT * FROM (WITH RECURSIVE r(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u) SELECT u, min(v) AS m FROM r GROUP BY u)),
links AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN links ON vec_id = links.u LEFT JOIN reach ON vec_id = reach.u
"""
