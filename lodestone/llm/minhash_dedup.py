"""MinHash near-dedup: a set similarity join by chosen paths.

Documents with equal shingle sets are one class. Trees branch the classes: a node picks coordinates of
the classes' minhash signatures and parts its members by their tokens there, by two coordinates at each
node, so that a tree keeps a pair of similarity 0.8 together on some path with a chance of about 0.94
at any depth, and one of TREES with 0.999.
Nodes of at most LEAF members are compared exhaustively by signature; larger ones compare all members
with a few pivots and branch on, unless all their members are already in one candidate cluster.

Candidate clusters are disjoint, so each is then judged by itself on its full shingle sets: an
inverted index over the cluster counts what a document shares with all others at once, and documents
of the largest component found so far need not be asked again. Clusters too large for one task are
judged by pivots first and then block by block for what the pivots left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import hot_join, read, release, slices, written
from lodestone.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Coordinates of a signature, 16 bits each.
WIDTH = 128
TREES = 3
LEAF = 4096
#: Signatures that agree in this share of coordinates belong to a candidate: 3.4 standard errors below 0.8.
CANDIDATE = 0.68
#: Levels after which a node that is still large is compared block by block.
DEEPEST = 8
#: Shingles of a cluster that one task judges, and those of a block of what pivots left over.
CLUSTER_SHINGLES = 3_000_000
BLOCK_SHINGLES = 400_000
BROADCAST_IDS = 2_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 2 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of bytes that end in white space; a polynomial in the bytes, so the same anywhere."""
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.cumprod(np.full(len(raw) + 1, _P, np.uint64))
    undo = np.cumprod(np.full(len(raw) + 1, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    return start, _mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text's lower-cased words, ascending within a text.

    A text of fewer words than n has their whole sequence as its one shingle, one without words none.
    """
    raws = [(t or "").encode("utf-8", "replace").lower() + b" " for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    start, word = _words(raw)
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    count = np.bincount(doc, minlength=len(texts))
    sums = np.zeros(len(word), np.uint64)
    for j in range(n):
        k = max(0, len(word) - j)
        same = np.zeros(len(word), bool)
        same[:k] = doc[j:] == doc[:k] if j < len(word) else False
        sums[:k] += np.where(same[:k], word[j:] if j < len(word) else word[:0], np.uint64(0)) * np.uint64((int(_P) * (2 * j + 1) + j) % (1 << 64) | 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    keep = (place + n <= count[doc]) | ((place == 0) & (count[doc] < n))
    hashes = _mix(sums[keep] + np.minimum(count[doc][keep], n).astype(np.uint64))
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.cumsum(each)
    distinct = np.ones(len(hashes), bool)
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            part = hashes[a:b]
            part.sort()
            distinct[a + 1 : b] = part[1:] != part[:-1]
    owner = np.repeat(np.arange(len(texts)), each)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[distinct], minlength=len(texts)))])
    return hashes[distinct], offsets


def class_keys(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, the same for equal sets; None for an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        a = np.add.reduceat(_mix(hashes * _P), offsets[full])
        b = np.add.reduceat(_mix(hashes * _Q), offsets[full]) ^ (np.diff(offsets)[full].astype(np.uint64) * _P)
        for k, pair in zip(full.tolist(), np.column_stack([a, b]).astype(">u8"), strict=True):
            out[k] = pair.tobytes()
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        made = np.empty((len(full), WIDTH), "<u2")
        for j in range(WIDTH):
            least = np.minimum.reduceat(hashes * _FACTORS[j] ^ _FACTORS[WIDTH + j], offsets[full])
            made[:, j] = _mix(least) >> np.uint64(48)
        for k, row in zip(full.tolist(), made, strict=True):
            out[k] = row.tobytes()
    return out


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, offsets = shingles(batch.column("text").to_pylist(), n)
                columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(class_keys(hashes, offsets), pa.binary()), pa.array(signatures(hashes, offsets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "sig"])
        release()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, offsets = shingles(batch.column("text").to_pylist(), n)
                keys = pa.array(class_keys(hashes, offsets), pa.binary())
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                wanted = pc.equal(keys, batch.column("key"))
                yield pa.RecordBatch.from_arrays([keys, sets], names=["key", "set"]).filter(wanted)
        release()

    return run


class _Forest:
    """Union-find; united() tells whether the two were apart."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def united(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows in groups of equal first columns; they come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(runs: Iterator[list[tuple]], judge) -> Iterator[pa.RecordBatch]:
    """What judge makes of each run, some pairs at a time."""
    out: list[tuple[bytes, bytes]] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["u", "v"])

    for rows in runs:
        if len(rows) > 1:
            out += judge(rows)
        if len(out) > 50_000:
            yield made()
            out = []
    yield made()


def _leaf(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of a node's candidates. side: of two blocks, -1 in a block that is compared with itself."""
    rows = sorted(rows, key=lambda r: r[1])
    sig = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), WIDTH)
    side = np.array([-1 if r[3] is None else r[3] for r in rows])
    forest = _Forest(len(rows))
    for i in range(len(rows) - 1):
        alike = (sig[i + 1 :] == sig[i]).mean(axis=1) >= CANDIDATE
        for j in (np.flatnonzero(alike & ((side[i + 1 :] != side[i]) | (side[i] < 0))) + i + 1).tolist():
            if forest.united(i, j):
                yield rows[i][1], rows[j][1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs(_runs(batches, ["node", "key", "sig", "side"]), _leaf)


def _judged(percent: int):
    def cluster(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        """A spanning forest of a cluster's links on full sets. asks: rows that are compared with all others (in a block), else None."""
        rows = sorted(rows, key=lambda r: r[1])
        n = len(rows)
        sets = [np.asarray(r[2], np.int64) for r in rows]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(n), size)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        posted = owner[order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
        at = np.concatenate([[0], np.cumsum(size)])
        forest = _Forest(n)
        asks = [i for i in range(n) if rows[i][3]]
        asked = set()

        def ask(i: int) -> Iterator[tuple[bytes, bytes]]:
            asked.add(i)
            own = inverse[at[i] : at[i + 1]]
            shared = np.bincount(np.concatenate([posted[begin[s] : begin[s + 1]] for s in own.tolist()]), minlength=n)
            for j in np.flatnonzero(100 * shared >= percent * (size + size[i] - shared)).tolist():
                if j != i and forest.united(i, j):
                    yield rows[i][1], rows[j][1]

        if len(asks) < n:
            for i in asks:
                yield from ask(i)
            return
        yield from ask(int(np.argsort(size, kind="stable")[n // 2]))
        roots = [forest.find(i) for i in range(n)]
        largest = np.bincount(roots).argmax()
        for i in range(n):
            if i not in asked and forest.find(i) != forest.find(int(largest)):
                yield from ask(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs(_runs(batches, ["place", "key", "set", "asks"]), cluster)

    return run


def _token(sig: Column, c: Column) -> Column:
    return F.substring(sig, c * 2 + 1, F.lit(2))


def _root(classes: DataFrame) -> DataFrame:
    """(node, key) two levels below the roots of all trees."""
    rng = np.random.default_rng(23)
    nodes = []
    for t in range(TREES):
        for c in rng.choice(WIDTH, 2, replace=False).tolist():
            for d in rng.choice([x for x in range(WIDTH) if x != c], 2, replace=False).tolist():
                nodes.append(F.xxhash64(F.lit(t), F.lit(c), _token(F.col("sig"), F.lit(c)), F.lit(d), _token(F.col("sig"), F.lit(d))))
    return classes.select("key", F.explode(F.array(*nodes)).alias("node"))


def _branch(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Children of the rows' nodes by two coordinates that the node picks."""
    signed = rows.join(classes.select("key", "sig"), "key")
    children = []
    for b in range(2):
        c = F.pmod(F.xxhash64("node", F.lit(level), F.lit(b)), F.lit(WIDTH)).cast("int")
        children.append(F.xxhash64("node", c, _token(F.col("sig"), c)))
    return signed.select("key", F.explode(F.array(*children)).alias("node"))


def _alike(a: str, b: str) -> Column:
    same = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: _token(F.col(a), i) == _token(F.col(b), i))
    return F.size(same) / F.lit(WIDTH)


def _streamed(rows: DataFrame, by: str, run, schema: str) -> DataFrame:
    """Groups of ``by`` one after the other, sorted within partitions."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, by).sortWithinPartitions(by).mapInArrow(run, schema)


def candidate_clusters(classes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(node, label): candidate clusters of class keys. classes: key, sig."""
    edges, labels = None, None
    nodes = _root(classes)
    for level in range(DEEPEST + 1):
        nodes = written(nodes.distinct(), "near-nodes")
        hashed = F.xxhash64("key", "node")
        many = nodes.groupBy("node").agg(F.count("*").alias("n"), F.array(F.min("key"), F.max("key"), F.min_by("key", hashed)).alias("pivots")).filter("n > 1")
        many = written(many, "near-sizes")
        placed = hot_join(nodes, many.select("node", "n"), "node", "n")
        small = placed.filter(F.col("n") <= leaf).select("node", "key", F.lit(None).cast("int").alias("side"))
        large = placed.filter(F.col("n") > leaf)
        if level == DEEPEST:  # block by block: each pair of blocks of a node is a leaf of its own
            blocks = F.ceil(F.col("n") * 2 / leaf).cast("int")
            own = F.pmod(F.xxhash64("key", F.lit(3)), blocks).cast("int")
            paired = large.select("node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
            side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
            small = small.unionByName(paired.select(pair.alias("node"), "key", side.alias("side")))
        signed = small.join(classes.select("key", "sig"), "key").select("node", "key", "sig", "side")
        found = _streamed(signed, "node", _compare, "u binary, v binary")
        hot = many.filter(F.col("n") > leaf)
        any_hot = level < DEEPEST and not hot.isEmpty()
        if any_hot:
            star = hot_join(large.select("node", "key"), hot.select("node", "n", F.array_distinct("pivots").alias("pivots")), "node", "n")
            star = star.select("key", F.explode("pivots").alias("pivot"))
            star = star.filter("key <> pivot").select(F.col("pivot").alias("u"), F.col("key").alias("v")).distinct()
            sigs = classes.select("key", "sig")
            star = star.join(sigs.select(F.col("key").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("key").alias("v"), F.col("sig").alias("b")), "v")
            found = found.unionByName(star.filter(_alike("a", "b") >= CANDIDATE).select("u", "v"))
        found = found if edges is None else found.unionByName(edges)
        edges = written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-candidates")
        labels = written(components(edges, "near-components"), "near-clusters")
        if not any_hot:
            return labels
        members = large.select("node", "key").join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
        label = F.coalesce("label", "key")
        apart = members.groupBy("node").agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a <> b").select("node")
        nodes = _branch(large.select("node", "key").join(apart, "node", "left_semi"), classes, level)
    return labels


def confirmed(docs: DataFrame, clusters: DataFrame, classes: DataFrame, n: int, percent: int, broadcast_ids: int = BROADCAST_IDS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """(node, label): components of links on full sets. The sets of clustered classes are made again from their documents."""
    members = clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster")).join(classes.select("key", "rep", "size"), "key")
    needed = written(members, "near-needed")
    wanted = needed.select("key", "rep")
    wanted = F.broadcast(wanted) if needed.count() <= broadcast_ids else wanted
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("text", "key")
    sets = texts.mapInArrow(_sets(n), "key binary, set array<bigint>").groupBy("key").agg(F.first("set").alias("set"))
    sets = written(sets.join(needed, "key"), "near-sets")
    weight = needed.groupBy("cluster").agg(F.sum("size").alias("weight"))
    weight = written(weight, "near-weights")
    light = sets.join(weight.filter(F.col("weight") <= cluster_shingles), "cluster")
    links = _streamed(light.select(F.col("cluster").alias("place"), "key", "set", F.lit(True).alias("asks")), "place", _judged(percent), "u binary, v binary")
    heavy = weight.filter(F.col("weight") > cluster_shingles)
    if not heavy.isEmpty():
        links = written(links.unionByName(_heavy_links(sets, heavy, percent)), "near-links")
    return written(components(links, "near-confirmed"), "near-labels")


def _heavy_links(sets: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """Links of large clusters: of all members with a few pivots; then of what isn't in the largest component so found, block by block."""
    sets = sets.join(F.broadcast(heavy), "cluster")  # no more than all shingles over CLUSTER_SHINGLES
    rank = F.xxhash64("key", F.lit(11))
    firsts = sets.groupBy("cluster").agg(F.min_by("key", rank).alias("a"), F.max_by("key", rank).alias("b"), F.min("key").alias("c"))
    pivots = firsts.select("cluster", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("key")).join(sets.select("key", "set"), "key")
    pivots = written(pivots.select("cluster", F.col("key").alias("u"), F.col("set").alias("pivot")), "near-pivots")
    common = F.size(F.array_intersect("set", "pivot"))
    star = sets.join(pivots, "cluster").filter("key <> u").filter(common * 100 >= percent * (F.size("set") + F.size("pivot") - common))
    star = written(star.select("u", F.col("key").alias("v")), "near-star")
    found = written(components(star, "near-star-components"), "near-star-labels")
    placed = sets.select("cluster", "key", "size").join(found.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = written(placed, "near-placed")
    largest = placed.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    left = placed.join(largest, "cluster").filter("label <> largest").select("cluster", "key", "size")
    blocks = left.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("across"))
    blocks = written(blocks.join(heavy.select("cluster", F.ceil(F.col("weight") / (4 * BLOCK_SHINGLES)).cast("int").alias("down")), "cluster"), "near-blocks")
    a = left.join(blocks, "cluster").select("cluster", "key", F.pmod(rank, F.col("across")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"), F.lit(True).alias("asks"))
    b = placed.join(blocks, "cluster").select("cluster", "key", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), F.pmod(F.xxhash64("key", F.lit(12)), F.col("down")).cast("int").alias("y"), F.lit(False).alias("asks"))
    cells = a.unionByName(b).groupBy("cluster", "key", "x", "y").agg(F.max("asks").alias("asks"))
    rows = cells.join(sets.select("key", "set"), "key").select(F.xxhash64("cluster", "x", "y").cast("string").cast("binary").alias("place"), "key", "set", "asks")
    return star.unionByName(_streamed(rows, "place", _judged(percent), "u binary, v binary"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF, broadcast_ids: int = BROADCAST_IDS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """Near-duplicate components of documents by their words' shingle sets.

    Links have 100 * intersection >= percent * union. Returns one row for each row of docs: doc_id,
    n_shingles (size of the set), component_id (least doc_id reachable by links), kept (whether it is
    this document's). Words are lower-cased A-Z. Documents without words or with a null text have an
    empty set and link with nothing; equal sets always link. A null id is above all others and is a
    component's id only where all are null. Rows that share an id and are in different components keep apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, key binary, sig binary"), "near-rows")
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    classes = written(classes, "near-classes")
    labels = confirmed(rows, candidate_clusters(classes, leaf), classes, shingle, percent, broadcast_ids, cluster_shingles)
    narrow = signed.select("doc_id", "n_shingles", "key")
    firsts = narrow.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", "first", "copies", F.coalesce("label", "key").alias("label"))
    firsts = written(firsts, "near-firsts")
    heads = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    heads = written(firsts.join(heads, "label").select("key", "component_id", "copies"), "near-heads")
    full = hot_join(narrow.filter("key IS NOT NULL"), heads, "key", "copies").select("doc_id", "n_shingles", "component_id")
    empty = narrow.filter("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), shingle=2)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM (SELECT * FROM s JOIN n USING (rid)) a JOIN (SELECT * FROM s JOIN n USING (rid)) b
  ON a.s = b.s AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rid, b.rid),
l AS (SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT r.u, min(o.doc_id) AS m FROM r JOIN d o ON o.rid = r.v GROUP BY r.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.u = d.rid
"""
