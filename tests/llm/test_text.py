"""Token files, SentencePiece, toxicity, language-model scores, urls, mixing and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import context_mixing as cm
from lodestone.llm import toxicity as tox
from lodestone.llm.mixing import mix
from lodestone.llm.pieces import Encoder, Pieces, decode_pieces, encode_pieces
from lodestone.llm.token_output import COUNTS, PieceEncoder, from_image, pack, read_tokens, to_image, unpack, write_tokens
from lodestone.llm.url_rules import RULES, filter_urls

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BPE, SP = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", None, "  a  b\n\n c", "\n", "a \n b", "x  y  z", "don't  stop", " lead", "tail ", "a\t b", "é  x", "<|endoftext|> a", "a\nb\n\nc", "a\n\n", "\nq", "x\ty\nz", "\u00a0x", "e\u2003", "a. b, c.. é. 9. \n, .", "▁x ▁", "Ⅷ ﬁ ①", "   ", "z" * 3000, "word " * 4000, "日本語 テキスト"]


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 40, 1 << 64])
def test_simple8b(n, high):
    values = np.random.default_rng(n).integers(0, high - 1, n, dtype=np.uint64, endpoint=True)
    values[n // 3 : n // 2] = 0
    block_at, words, escape_at, escapes = pack(values)
    assert (unpack(n, block_at, words, escapes) == values).all()
    assert len(escape_at) == len(escapes) == (values >> np.uint64(60) > 0).sum()
    ids, sizes = from_image(to_image(values, np.array([n])))
    assert (ids == values).all() and sizes.tolist() == [n]


def test_simple8b_is_dense():
    _, words, _, _ = pack(np.zeros(6000, np.uint64))
    assert len(words) <= 6000 / COUNTS[-1] + 12
    with pytest.raises(ValueError, match="shard"):
        from_image(b"x" * 40)


def test_piece_encoder_matches_library():
    encoder, library = PieceEncoder(BPE, 0), Tokenizer.from_file(BPE)
    special = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> ", "x <|endoftext|>\n\n<|endoftext|><|endoftext|> y  z", "<|endoftext", "|endoftext|>", "<|endoftext|>" * 300]
    assert library.encode(special[0], add_special_tokens=False).ids == [50256]
    for texts in (TEXTS, TEXTS[::-1], TEXTS, special, special[::-1]):
        ids, sizes = encoder.encode([t or "" for t in texts])
        expected = [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert sizes.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_token_files(spark, tmp_path):
    rows = [(len(TEXTS) - k, t) for k, t in enumerate(TEXTS)] + [(None, "none"), (3, "again")]
    docs = spark.createDataFrame([(*r, "c", [0], b"i") for r in rows], "doc_id long, text string, part string, doc_ids array<long>, image binary")
    write_tokens(docs, str(tmp_path / "t"), BPE)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    tokenizer = Tokenizer.from_file(BPE)
    start, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    write_tokens(docs.limit(0), str(tmp_path / "none"), BPE)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def best_path(pieces, text):
    """Viterbi by trying every piece at every place."""
    score = {p: s for p, s, _ in pieces.table}
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 20), end):
            if text[begin:end] in score:
                best[end] = max(best[end], best[begin] + score[text[begin:end]])
        if text[end - 1] not in pieces.single:
            best[end] = max(best[end], best[end - 1] + pieces.unknown)
    return best[-1]


def test_pieces_best_and_exact():
    encoder = Encoder(SP)
    score = {i: s for _, s, i in encoder.pieces.table}
    for text in [t for t in TEXTS if t and len(t) < 200]:
        ids, _ = encoder.encode([text])
        assert ids.tolist() == encoder.pieces.encode_text(text)
        assert Pieces(SP).decode_text(ids.tolist()) == text
    for text in ["▁hello▁world", "▁internationalization▁of▁things", "▁ab\ncd"]:
        ids = encoder.pieces.viterbi(text)
        unknown = sum(c not in encoder.pieces.single for c in text)
        assert sum(score.get(i, 0) for i in ids) + unknown * encoder.pieces.unknown == pytest.approx(best_path(encoder.pieces, text))


def test_pieces_long_runs():
    encoder = Encoder(SP)
    texts = ["0" * 5000, "\n" * 5000, "\U0001f600" * 5000, "日本語漢字" * 1000, "word" + "0" * 5000 + "\n" * 5000]
    ids, offsets = encoder.encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == encoder.pieces.encode_text(text)
        assert Pieces(SP).decode_text(ids[a:b].tolist()) == text
    assert len(encoder.chunks.ids) <= 2 * len(ids)  # no prefix of a run is kept


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    rows = decode_pieces(encode_pieces(docs, SP), SP).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == dict(enumerate(TEXTS))
    assert {r["doc_id"]: r["piece_ids"] for r in rows}[1] is None
    assert encode_pieces(docs.limit(0), SP).count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    clean = ["the", "river", "market", "talks", "about", "grain", "ships", "and", "prices", "people", "of", "today"]
    rows = []
    for k in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), "scoundrel" + rng.choice(["s", "ly", "ish", "x", "zz", str(rng.randrange(99))]))
        rows.append((k, " ".join(words), y))
    return rows


def test_toxicity_holds_out(spark):
    rows = toxic_rows(300, 1)
    learn = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "scoundrelhood"), (1002, "the " * 20_000 + "scoundrelmost")], "doc_id long, text string")
    model = tox.fit(docs, learn)
    got = {r["doc_id"]: r["toxicity"] for r in tox.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0)
    assert got[1000] == got[1001] < 0.5 < got[None]
    assert 0 <= min(got.values()) and max(got.values()) <= 1
    again = {r["doc_id"]: r["toxicity"] for r in tox.score_toxicity(docs, tox.fit(docs, learn)).collect()}
    assert again == got


@pytest.mark.parametrize(("labels", "score"), [([], 0), ([(1, 1), (2, 1)], 1), ([(1, 0), (None, 1), (2, None)], 0)])
def test_toxicity_without_both_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(abs(r["toxicity"] - score) < 1e-6 for r in tox.score_toxicity(docs, model).collect())


def test_lm_scores(spark):
    rng = random.Random(2)
    vocabulary = [f"word{k}x" for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=40)), k % 5 != 1) for k in range(80)] + [(100, None, True), (101, "", False), (102, "Zebra\xa0q WORD1X", False), (None, "word1x", None)]
    out = cm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, fold boolean"), "fold").collect()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, _ in rows}
    count = Counter(w for i, _, f in rows if f for w in tokens[i])
    total, distinct = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        own = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(count[w] > 0 for w in own) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / sum(len(cm.unit(w)) for w in own))
    known = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 80]
    assert sum(r["score"] for r in known) / sum(r["n_tokens"] for r in known) > -2.2
    strange = next(r for r in out if r["doc_id"] == 102)
    assert strange["score"] / strange["n_tokens"] < -2.5
    assert cm.score_documents(spark.createDataFrame([], "doc_id long, text string"), "true").count() == 0


def test_lm_scores_running_text(spark):
    rng = random.Random(3)
    after = [[rng.randrange(200) for _ in range(3)] for _ in range(200)]

    def text(n):
        at, words = rng.randrange(200), []
        for _ in range(n):
            words.append(f"word{at}x")
            at = rng.choice(after[at])
        return words

    texts = [text(60) for _ in range(220)]
    salads = [rng.sample(t, len(t)) for t in texts]
    rows = [(k, " ".join(t), k < 200) for k, t in enumerate(texts)] + [(1000 + k, " ".join(t), False) for k, t in enumerate(salads) if k >= 200]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in cm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, fold boolean"), "fold").collect()}
    assert all(got[k] > got[1000 + k] + 0.5 for k in range(200, 220))
    # What was learned from is scored without its own occurrence, so no better than what wasn't.
    assert abs(sum(got[k] for k in range(200)) / 200 - sum(got[k] for k in range(200, 220)) / 20) < 0.15


def test_lm_is_a_distribution():
    words = [b"", b"a", b"ab", b"b"]
    tables = [np.zeros(2 << s) for s in cm.SLOTS]
    cm.count(words, np.array([5, 3, 2, 1]), tables)
    mixer = cm.Mixer([cm.code(t[0::2]).astype(np.uint16) | (cm.code(t[1::2]).astype(np.uint16) << 8) for t in tables])
    mixer.learn(words * 50, np.ones(200))
    # One byte at a word's start: the probabilities of all 256 add up to one.
    scores = np.array([mixer.score([bytes([b])]) for b in range(256) if b not in (10, 32)]).ravel()
    assert 0 < (10**scores).sum() < 1
    assert mixer.score([b""])[0] > mixer.score([b"b"])[0]


def judged(rules, host, path):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls(spark):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "example.org", "notexample.com", "Example.COM"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/2", "/en/x/y"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "https") for h in hosts for p in paths for q in ("", "?a=://b/", "#c")]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://EXAMPLE.com:80/en/"]
    rows = [(rng.randrange(300), u, "x") for u in urls] + [(None, urls[5], "x")]
    rules = [*RULES, ("x.net", "/", "block"), ("b.example.com", "/en/", "block"), ("com", "/en/x/y", "block"), ("com", "", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), table).collect()
    expected = []
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        expected.append((i, host, path, *judged(rules, host, path)))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r) for r in out], key=order) == sorted(expected, key=order)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), none).collect()} == {"allow"}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choices(["a", "b", "c", None], [10, 4, 4, 1])[0], "x") for k in range(900)] + [(7, "w w", "a", "x")] * 3 + [(None, None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    out = mix(docs).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    weight = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * rest / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    by_size = {v: s for s, v in sizes.items()}
    taken = Counter()
    for r in out:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[s] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 61 for s in sizes)
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, out))
    assert mix(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    rows, seen = docs, {}
    for name, stage in pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, SF).collect(), stage(spark, rows, SF).schema)
        seen[name] = rows
        assert name == names[-1] or rows.columns == docs.columns
    scores = {r["doc_id"]: r["toxicity"] for r in tox.score_toxicity(docs, tox.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in seen[names[0]].collect()} == {i for i, s in scores.items() if s < 0.5}
    near = seen[names[2]].collect()
    sets = []
    for r in near:
        w = r["text"].encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a))
    last = seen[names[-1]].collect()
    assert all(r["round_trip"] for r in last) and len(last) == seen[names[3]].count()
    assert {tuple(r["piece_ids"]) for r in last} <= {tuple(Encoder(SP).pieces.encode_text(r["text"])) for r in near}
