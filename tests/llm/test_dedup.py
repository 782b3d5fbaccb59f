"""Exact, line, near and embedding dedup against brute force on small tables."""

import hashlib
import random
from collections import defaultdict

import pytest

from lodestone.llm.components import components
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.hnsw_dedup import embedding_dedup
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.minhash_dedup import near_dedup, shingles

DOC = "doc_id long, text string, source string, keep_id string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOC)


def unite(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


EXACT = [(1, "Hello World", "a"), (2, "hello world", "b"), (3, None, "a"), (4, "", None), (5, "É", "a"), (6, "é", "a"), (None, "HELLO WORLD", "c"), (7, "x" * 9000 + "a", "a"), (8, "X" * 9000 + "b", "a"), (9, "x" * 9000 + "A", "a"), (2, "hello world", "b")]


@pytest.mark.parametrize("limit", [0, 64, 1 << 20])
@pytest.mark.parametrize("hot", [1, 1000])
def test_exact(spark, limit, hot):
    table = docs(spark, EXACT)
    rows = exact_dedup(table, broadcast_bytes=limit, hot_rows=hot, digest_all=True).collect()
    got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert got == sorted([(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (-1, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 9, 2, False), (9, 9, 2, True), (8, 8, 1, True)])
    text = {r[0]: (r[1] or "") for r in EXACT}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert all(r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].translate(lower).encode()).hexdigest() for r in rows)
    # The same rows whatever the limit; a hash only where length and prefix left a row with others.
    less = exact_dedup(table, broadcast_bytes=limit, hot_rows=hot).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in less) == got
    assert {r["doc_id"] for r in less if r["text_sha256"] is None} == {5, 6}
    full = {(r["doc_id"], r["text_sha256"]) for r in rows}
    assert all((r["doc_id"], r["text_sha256"]) in full for r in less if r["text_sha256"])


def test_exact_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


LINE = "this line is shared by sites"
LINES = [(1, f"{LINE}\nown one", "a"), (2, f"own two\n{LINE} ", "b"), (3, f"{LINE}\n{LINE}\nown", "c"), (4, f"{LINE}", None), (5, None, "a"), (6, "", "b"), (7, "short\nonly on two sites", "a"), (8, "short\nonly on two sites", "b"), (9, "short", "c"), (None, "nothing shared here", "z")]
PASSAGE = " ".join(f"word{k}" for k in range(60))
LINES += [(20, f"{PASSAGE}\nx", "a"), (21, f"y\n{PASSAGE}", "a"), (22, PASSAGE, "b"), (23, PASSAGE[:-3], "a"), (24, PASSAGE[:-3], "a"), (25, "w " * 60_000, "a")]


@pytest.mark.parametrize(("limit", "hot"), [(0, 2), (0, 1000), (1000, 2)])
def test_lines(spark, limit, hot):
    table = docs(spark, LINES).withColumnsRenamed({"keep_id": "lines_total"})
    rows = {r["doc_id"]: r for r in line_dedup(table, broadcast_lines=limit, hot_rows=hot).collect()}
    assert rows[20]["text"] == f"{PASSAGE}\nx" and rows[21]["text"] == "y" and rows[22]["text"] == ""  # two sites are enough for a passage
    assert rows[23]["text"] == rows[24]["text"] == PASSAGE[:-3]  # but not one
    assert rows[25]["text"] == "w " * 60_000
    assert rows[1]["text"] == f"{LINE}\nown one" and rows[1]["lines_removed"] == 0
    assert rows[2]["text"] == "own two" and rows[2]["lines_removed"] == 1
    assert rows[3]["text"] == "own" and rows[3]["lines_total"] == 3
    assert rows[4]["text"] == "" and rows[4]["lines_removed"] == 1
    assert rows[5]["text"] is None and rows[5]["lines_total"] == 0
    assert rows[6]["text"] == "" and rows[6]["lines_removed"] == 0
    assert rows[8]["text"] == "short\nonly on two sites"
    assert rows[None]["text"] == "nothing shared here"
    assert rows[1]["key"] == "y"  # further columns stay


def test_lines_empty(spark):
    assert line_dedup(docs(spark, [])).count() == 0


def shingle_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_shingles(n):
    texts = ["a b c d e f", "", None, "A b", "x", "a b a b a b", "\tq\n\x0bw e", "é é\xa0é", "a  b c d e f "]
    hashes, offsets = shingles(texts, n)
    sets = shingle_sets(texts, n)
    assert (offsets[1:] - offsets[:-1]).tolist() == [len(s) for s in sets]
    made = [frozenset(hashes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(made[a] & made[b]) == len(sets[a] & sets[b])


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    texts += ["", None, "w1", "W1", "w1 w2", " w1\tw2", "w1 w2 w3"]
    return texts


@pytest.mark.parametrize(("leaf", "cluster", "ids"), [(4096, 3_000_000, 10_000), (6, 300, 0)])
def test_near(spark, leaf, cluster, ids):
    texts = near_rows(4)
    sets = shingle_sets(texts, 2)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = unite(len(texts), links)
    rows = near_dedup(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), shingle=2, leaf=leaf, cluster_shingles=cluster, broadcast_ids=ids).collect()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_candidates_below_large_nodes(spark):
    import numpy as np

    from lodestone.llm.minhash_dedup import WIDTH, _leaf, candidate_clusters

    rng = np.random.default_rng(8)
    n = 600
    # Two of three tokens are common to all, so that nodes stay large for some levels; pairs agree in 0.8 of the coordinates.
    sigs = np.where(rng.random((n, WIDTH)) < 0.7, 1, rng.integers(2, 1 << 16, (n, WIDTH)))
    fresh = rng.integers(2, 1 << 16, (n, WIDTH))
    for row in fresh:
        row[rng.permutation(WIDTH)[26:]] = 0
    copies = np.where(fresh > 0, fresh, sigs)
    rows = [(f"{k % n}-{k // n}".encode(), bytearray(sig.astype("<u2").tobytes())) for k, sig in enumerate(np.concatenate([sigs, copies]))]
    labels = {bytes(r["node"]): r["label"] for r in candidate_clusters(spark.createDataFrame(rows, "key binary, sig binary"), leaf=60).collect()}
    met = sum(labels.get(f"{k}-0".encode(), 0) == labels.get(f"{k}-1".encode(), 1) for k in range(n))
    assert met >= 0.998 * n, met
    less = sigs[0].copy()
    less[:40] = 0  # 88 of 128 coordinates agree
    assert len(list(_leaf([(0, b"a", sigs[0].astype("<u2").tobytes(), None), (0, b"b", less.astype("<u2").tobytes(), None)]))) == 1


def test_near_branches_twice(spark):
    from lodestone.llm.minhash_dedup import WIDTH, _branch

    classes = spark.createDataFrame([(bytes([k]), bytearray([k] * 2 * WIDTH)) for k in range(40)], "key binary, sig binary")
    nodes = spark.createDataFrame([(bytes([k]), k) for k in range(40)], "key binary, node long")
    assert _branch(nodes, classes, 0).distinct().groupBy("key").count().filter("count = 2").count() == 40


def test_near_odd_rows(spark):
    rows = near_dedup(docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (5, None, "s"), (6, "", "s"), (None, "zz", "s")]), shingle=2).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (5, 5, True), (6, 6, True)]
    assert near_dedup(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    expected = unite(200, links)
    hot = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long"), hot_rows=3).collect()}
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert hot == {r["node"]: r["label"] for r in rows}
    assert {r["node"]: r["label"] for r in rows} == {x: expected[x] for pair in links for x in pair if pair[0] != pair[1] or expected[x] != x or any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n_links int"


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.08 * rng.random()).astype(np.float32).tolist(), k % 3, 0))
    rows += [(len(rows), rows[0][1], 0, 0), (len(rows) + 1, rows[0][1], 1, 0), (len(rows) + 2, None, 1, 0), (len(rows) + 3, [0.0] * 16, 1, 0), (len(rows) + 4, rows[0][1], None, 0), (len(rows) + 5, [float("nan")] * 16, 1, 0), (len(rows) + 6, [1.0], 1, 0), (len(rows) + 7, [], 1, 0), (len(rows) + 8, [None] + [1.0] * 15, 1, 0), (len(rows) + 9, [float("inf")] * 16, 1, 0)]
    n = len(rows)
    unit = []
    for _, v, label, _ in rows:
        ok = label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
        unit.append((label, np.array(v, float) / np.linalg.norm(np.array(v, float))) if ok else None)
    links = [(a, b) for a in range(n) for b in range(a) if unit[a] and unit[b] and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and float(unit[a][1] @ unit[b][1]) >= 0.98]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    expected = unite(n, links)
    for shard in (16_384, 20):  # one shard a label, and several
        got = {r["vec_id"]: r for r in embedding_dedup(spark.createDataFrame(rows, VECTORS), shard=shard).collect()}
        assert [got[k]["component_id"] for k in range(n)] == expected
        assert [got[k]["n_links"] for k in range(n)] == [degree[k] for k in range(n)]
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_recall():
    import numpy as np

    from lodestone.llm.hnsw_dedup import Graph

    rng = np.random.default_rng(0)
    for n in (60, 600):
        x = rng.normal(size=(n, 24))
        x[n // 2 :] = x[: n // 2] + rng.normal(size=(n // 2, 24)) * 0.02
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        graph = Graph(x)
        truth = (x @ x.T >= 0.98).sum()
        assert sum(len(graph.near(q, 0.98, 12)) for q in x) >= 0.98 * truth


def test_dense_group_is_walked(monkeypatch):
    """A beam full of hits grows along the graph's links; the shard isn't looked at as a whole."""
    import numpy as np

    from lodestone.llm.hnsw_dedup import Graph

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[:700] = x[0] + rng.normal(size=(700, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, most = Graph(x), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, list | np.ndarray):
                most[-1] += len(key)
            return np.asarray(self)[key]

        def __matmul__(self, q):
            raise AssertionError("the whole shard was looked at")

    truth = [set(np.flatnonzero(x @ q >= 0.98).tolist()) for q in x]
    graph.x = graph.x.view(Counted)
    got = []
    for q in x:
        most.append(0)
        got.append(set(graph.near(q, 0.98 - 1e-4, 12)))
    assert np.mean([len(t & g) / len(t) for t, g in zip(truth, got, strict=True)]) >= 0.995
    assert max(len(t) for t in truth) > 300 and np.mean(most) < 1200


class Shy:
    """Finds no isolated pair while its beam is small."""

    def __init__(self, x):
        self.x = x

    def near(self, q, threshold, beam):
        hits = [k for k, s in enumerate((self.x @ q).tolist()) if s >= threshold]
        return hits if len(hits) > 2 or beam >= 100 else []


def test_audit_sees_isolated_pairs():
    import numpy as np
    import pandas as pd

    from lodestone.llm.hnsw_dedup import Graph, _query, packed

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 24))
    x[:300] = x[0] + rng.normal(size=(300, 24)) * 0.005
    x[500:] = x[300:500] + rng.normal(size=(200, 24)) * 0.005
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = pd.DataFrame({"cid": np.arange(700), "embedding": list(x), "block": np.arange(700) % 2})
    index = pd.DataFrame({"state": [packed(np.arange(700), np.ones(700, int), x, Graph(x[:5]))]})
    truth = x @ x.T >= 0.98
    for load in (lambda v, _: Shy(v), lambda v, _: Graph(v)):
        out = _query(0.98, load)(queries, index)
        assert set(out["u"]) == set(range(700))
        assert out.groupby("u")["n"].sum().tolist() == (truth.sum(axis=1) - 1).tolist()
        tree = out[out["v"].notna()]
        assert len(tree) < 700 and unite(700, zip(tree["u"].astype(int), tree["v"].astype(int))) == unite(700, np.argwhere(truth).tolist())
    one = Graph(x[:200])
    again = Graph.load(one.x, np.load(__import__("io").BytesIO(packed(np.arange(200), np.ones(200, int), one.x, one))))
    assert all(again.near(v, 0.98, 12) == one.near(v, 0.98, 12) for v in x[:50])
    graph = Graph(x[:40])
    graph.layers = [{k: np.zeros(0, np.int64) for k in range(40)}]  # nothing can be reached from the entry
    assert sorted(graph.near(x[3], 0.98, 12)) == list(range(40))
