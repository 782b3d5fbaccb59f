"""Registered queries and pipeline stages on small odd tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import catalog
from lodestone.llm import context_mixing as cm
from lodestone.llm import toxicity as tox
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.minhash_dedup import near_dedup
from lodestone.llm.mixing import mix
from lodestone.llm.pieces import Encoder, Pieces
from lodestone.llm.url_rules import RULES, filter_urls
from tests.llm.test_dedup import shingle_sets, unite
from tests.llm.test_text import BPE, SF, SP, judged, toxic_rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"long{k % 5000}" for k in range(60_000))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())


def odd_documents():
    """Invented prose, then nulls, empty and long texts, ties, copies and nothing but blanks."""
    rows = [(k, t, "en", "abc"[k % 3]) for k, t, _ in toxic_rows(40, 9)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t", "en", None), (103, LONG, "en", "a"), (104, LONG.upper(), None, "b")]
    rows += [(105, rows[3][1], "en", "c"), (106, "Zürich ▁ \U0001f600 <|endoftext|>", "de", "b"), (107, "one", "en", "a"), (108, "ONE", "en", "a")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of one odd corpus, with further columns whose names clash with results."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(*r, "x", 7, b"i") for r in odd_documents()]
    spark.createDataFrame(rows, f"{DOCUMENTS}, score string, kept int, image binary").write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, y) for k, _, y in toxic_rows(40, 9)] + [(None, 1, 1), (101, None, None), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://example.com/en/a", None), (2, None, "x"), (3, "https://WWW.example.com/en/" + "y" * 200_000, None), (None, "http://q.net/es/?", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    path = tmp_path_factory.mktemp("nothing")
    for table in ("documents", "labels", "pages"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{path}/{table}.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def rows_of(spark, folder, name):
    out = catalog.QUERIES[name](spark, folder).collect()
    return {r[0]: r for r in out}, out


def test_queries_on_empty_tables(spark, nothing):
    for name, query in catalog.QUERIES.items():
        assert query(spark, nothing).collect() == [], name


def test_op1(spark, folder):
    got, out = rows_of(spark, folder, "op1_token_output")
    library, start = Tokenizer.from_file(BPE), 0
    docs = sorted(odd_documents(), key=lambda r: r[0])
    assert len(out) == len(docs)
    for i, text, *_ in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2(spark, folder):
    got, _ = rows_of(spark, folder, "op2_exact_dedup")
    groups = defaultdict(list)
    for i, text, *_ in odd_documents():
        groups[(text or "").translate(LOWER)].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op4(spark, folder, tmp_path):
    got, out = rows_of(spark, folder, "op4_toxicity")
    assert len(out) == len(odd_documents()) and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert got[100]["score"] == got[101]["score"] and got[3]["score"] == got[105]["score"]
    # Labels of held-out rows are never seen: turned over, they change no score.
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = [(r["doc_id"], r["quality"], 1 - r["toxic"] if r["doc_id"] is not None and r["toxic"] is not None and got.get(r["doc_id"], {"held_out": False})["held_out"] else r["toxic"]) for r in labels.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turned, labels.schema).write.parquet(f"{tmp_path}/labels.parquet")
    assert turned != [tuple(r) for r in labels.collect()]
    again, _ = rows_of(spark, str(tmp_path), "op4_toxicity")
    assert {i: r["score"] for i, r in again.items()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_odd_rows(spark):
    model = tox.fit(*(spark.createDataFrame(r, s) for r, s in (([(k, t) for k, t, _ in toxic_rows(60, 2)], "doc_id long, text string"), ([(k, y) for k, _, y in toxic_rows(60, 2)], "doc_id long, toxic int"))))
    docs = spark.createDataFrame([(1, "scoundrelzz", "a"), (1, "scoundrelzz", "b"), (None, None, "c")], "doc_id long, text string, toxicity string")
    out = tox.score_toxicity(docs, model)
    assert dict(out.dtypes)["toxicity"] == "double"
    a, b, none = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert a == b and none["toxicity"] < 0.5
    assert tox.score_toxicity(docs.limit(0), model).collect() == []


def test_op5(spark, folder):
    _, out = rows_of(spark, folder, "op5_url_rules")
    got = {r["page_id"]: tuple(r)[1:] for r in out}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block") and got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/" + "y" * 200_000, "www.example.com/en/", "allow") and got[None] == ("q.net", "/es/", "net/es/", "block")
    assert judged(RULES, "q.net", "/es/") == ("net/es/", "block")
    pages = spark.createDataFrame([], "page_id long, url string, host string, rule int")
    assert filter_urls(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string")).collect() == []


def test_op6(spark, folder):
    got, out = rows_of(spark, folder, "op6_sentencepiece")
    encoder = Encoder(SP)
    assert len(out) == len(odd_documents())
    for i, text, *_ in odd_documents():
        ids = encoder.pieces.encode_text(text or "")
        assert got[i]["n_ids"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and got[i]["round_trip"]


def test_pieces_ties():
    """Of paths of equal score the one with the longest last piece stays. Reruns and cut texts agree."""
    equal = Pieces(SP)
    equal.table = [("a", -1.0, 0), ("aa", -2.0, 1), ("aaa", -3.0, 2)]
    equal.build()
    assert [equal.viterbi("a" * n) for n in (1, 2, 3, 4, 6)] == [[0], [1], [2], [0, 2], [2, 2]]
    encoder = Encoder(SP)
    runs = [c * n for c in "aeo-=.x0" for n in range(1, 40)] + ["abab" * k for k in range(1, 20)]
    ids, at = encoder.encode(runs)
    fresh, fresh_at = Encoder(SP).encode(runs[::-1])
    whole = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert whole == [fresh[a:b].tolist() for a, b in zip(fresh_at[:-1], fresh_at[1:], strict=True)][::-1]
    assert whole == [encoder.pieces.encode_text(r) for r in runs]


def test_op7(spark, folder):
    got, out = rows_of(spark, folder, "op7_lm_scoring")
    docs = odd_documents()
    tokens = {i: [*words(t), b""] for i, t, *_ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    total, distinct = sum(count.values()), len(count)
    assert len(out) == len(docs) and set(held.values()) == {True, False}
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_lm_odd_rows(spark):
    rows = [(1, "alpha beta gamma", "true"), (1, "alpha beta gamma", "true"), (None, "alpha beta", "x"), (2, None, "x"), (3, LONG, "x")]
    out = cm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r)
    assert len(out) == 5 and by_id[1][0] == by_id[1][1] and by_id[2][0]["n_tokens"] == 1 and by_id[3][0]["n_tokens"] == 60_001
    assert all(r["train_tokens"] == 4 + 4 + 3 + 1 + 60_001 for r in out)


def near_by_hand(texts, n):
    """Least place reachable by links, found through an inverted list of shingles."""
    sets = shingle_sets(texts, n)
    places, links = defaultdict(list), []
    for k, s in enumerate(sets):
        met = Counter(o for x in s for o in places[x])
        links += [(k, o) for o, c in met.items() if 100 * c >= 80 * (len(s) + len(sets[o]) - c)]
        for x in s:
            places[x].append(k)
    return sets, unite(len(texts), links)


def test_op9(spark, folder):
    got, out = rows_of(spark, folder, "op9_minhash_dedup")
    docs = sorted(odd_documents())
    sets, first = near_by_hand([r[1] for r in docs], 2)
    assert len(out) == len(docs) and len(sets[[r[0] for r in docs].index(103)]) == 5000
    for k, r in enumerate(docs):
        g = got[r[0]]
        assert (g["n_shingles"], g["component_id"], g["kept"]) == (len(sets[k]), docs[first[k]][0], first[k] == k)
    assert got[104]["component_id"] == 103 and got[105]["component_id"] == 3 and got[108]["component_id"] == 107


def mixed_by_hand(rows, seed=17):
    """Copies of (id, text, source) rows with different ids by whole numbers, and each source's size and target."""
    size = {i: len(words(t)) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i, _, s in rows:
        sizes[s] += size[i]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest, free = sum(sizes.values()) - 3 * sum(sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and 3 * sizes[s] * free <= weight[s] * rest}
        if not over:
            break
        capped |= over
    target = {s: float(3 * sizes[s]) if s in capped else float(weight[s] * rest) / free for s in names}
    copies = {}
    for s in names:
        rate = math.floor(target[s] / sizes[s] * (1 << 32)) if sizes[s] else 0
        at = int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:8], 16)
        for i in sorted((i for i, _, o in rows if o == s), key=lambda i: (size[i], i)):
            copies[i] = (at + rate >> 32) - (at >> 32)
            at += rate
    return size, sizes, target, copies


def test_op10(spark, folder):
    got, out = rows_of(spark, folder, "op10_source_mixing")
    docs = [(i, t, s) for i, t, _, s, _ in odd_documents()]
    size, sizes, target, copies = mixed_by_hand(docs)
    assert len(out) == len(docs)
    for i, _, s in docs:
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size[i], sizes[s], size[i] * copies[i])
        assert r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]


def test_line_names_that_clash(spark):
    line = "the same line on every site"
    rows = [(k, f"{line}\nown text {k}", s, "x", 9) for k, s in enumerate("abcd")]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, lines_total string, lines_removed int"))
    assert sorted((r["doc_id"], r["lines_total"], r["lines_removed"]) for r in out.collect()) == [(0, 2, 0), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert dict(out.dtypes)["lines_total"] == dict(out.dtypes)["lines_removed"] == "bigint"


def lines_by_hand(docs):
    """(id, text, ...) rows without boilerplate lines, those whose every line goes left out."""
    sites, first = defaultdict(set), {}
    for i, text, _, source, _ in docs:
        for pos, line in enumerate(text.split("\n") if text is not None else ()):
            key = line.strip(" ")
            if len(key) >= 12:
                sites[key].add(source)
                first[key] = min(first.get(key, (i, pos)), (i, pos))
    out = []
    for i, text, lang, source, n in docs:
        if text is None:
            out.append((i, None, lang, source, None))
            continue
        lines = text.split("\n")
        stays = []
        for pos, line in enumerate(lines):
            key = line.strip(" ")
            least = 2 if len(words(key)) >= 50 else 3
            if len(key) < 12 or len(sites[key]) < least or first[key] == (i, pos):
                stays.append(line)
        if stays:
            out.append((i, "\n".join(stays), lang, source, len("\n".join(stays))))
    return out


def test_pipeline_by_hand(spark):
    """run() over a whole table against plain Python, from the toxicity model's scores on."""
    import corpus_pipeline as pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = tox.score_toxicity(docs, tox.fit(docs, labels)).collect()
    rows = lines_by_hand(sorted(tuple(r)[:5] for r in scored if r["toxicity"] < 0.5))
    _, first = near_by_hand([r[1] for r in rows], 5)
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    copies = mixed_by_hand([(i, t, s) for i, t, _, s, _ in rows])[3]
    encoder = Encoder(SP)
    expected = sorted((i, s, tuple(encoder.pieces.encode_text(t)), True) for i, t, _, s, _ in rows for _ in range(copies[i]))
    got = sorted((r["doc_id"], r["source"], tuple(r["piece_ids"]), r["round_trip"]) for r in pipeline.run(spark, SF).collect())
    assert [g[:2] for g in got] == [e[:2] for e in expected] and got == expected


def test_stages_on_odd_rows(spark, folder):
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    calm = "the river market talks about grain " * 10_000
    odd = [(201, "the river market talks", "en", "a", 22), (201, "the river market talks", "en", "a", 22), (None, "scoundrelzz scoundrelly", "en", "b", 1), (None, "grain ships", None, None, None), (204, None, None, None, None), (205, "", "en", "a", 0), (206, calm, "en", "c", None)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in odd], f"{DOCUMENTS}, kept string, copies int, toxicity int")
    learned = [(k, t, "en", "a", 0, "x", 1, 2) for k, t, _ in toxic_rows(40, 9)]
    order = lambda rows: sorted(rows, key=str)
    for name, stage in pipeline.STAGES:
        none = stage(spark, table.limit(0), folder)
        assert none.collect() == [] and (name == "SentencePiece encoding" or none.columns == list(pipeline.COLUMNS)), name
    got = stages["toxicity"](spark, table.union(spark.createDataFrame(learned, table.schema)), folder).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200} == {k for k, _, y in toxic_rows(40, 9) if not y}
    got = [r for r in got if r["doc_id"] is None or r["doc_id"] > 200]
    assert order(tuple(r) for r in got) == order(r for r in odd if r[1] != odd[2][1])
    got = stages["line dedup"](spark, table, folder).collect()
    assert order(tuple(r) for r in got) == order((*r[:4], None if r[1] is None else len(r[1])) for r in odd)
    got = stages["MinHash near-dedup"](spark, table, folder).collect()
    assert order(tuple(r) for r in got) == order(odd[1:])
    got = stages["source mixing"](spark, table, folder).collect()
    assert order(got) == order(stages["source mixing"](spark, table, folder).collect())
    assert {tuple(r)[:2] for r in got} <= {r[:2] for r in odd} and max(Counter(r["doc_id"] for r in got if r["doc_id"]).values()) <= 6
    got = {(r["doc_id"], r["source"]): r for r in stages["SentencePiece encoding"](spark, table, folder).collect()}
    assert got[204, None]["piece_ids"] is None and got[204, None]["n_ids"] == 0 and got[205, "a"]["piece_ids"] == [] and all(r["round_trip"] for r in got.values())


def test_operators_on_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, LONG, "a", 0), (2, LONG + " more", "b", 0), (3, "", None, 0)], "doc_id long, text string, source string, size int")
    near = {r["doc_id"]: r for r in near_dedup(docs).collect()}
    assert near[2]["component_id"] == 1 and near[3]["component_id"] == 3 and near[1]["n_shingles"] == 5000
    assert {r["doc_id"]: r["size"] for r in mix(docs).collect()} == {1: 60_000, 2: 60_001, 3: 0}
