"""Language-model scores by online logistic context mixing.

The text that is scored is its lower-cased words, each as its bytes with a blank behind them, and an
end byte. Three models of different reach are mixed:

Spelling. Bits are predicted one by one: four hashed contexts (the last 1, 2, 3 and 4 bytes of the
word, with the byte's bits so far) each keep counts of zeros and ones. Their log odds are combined by
weights that a gate picks by place and by how much the two longest contexts have seen, and the mix is
refined by an adaptive map from (bits so far, mix) to what came true. Counts come from the table of
distinct words with how often training has each; weights and map are learned online over all of it, each
word predicted with one occurrence of its own left out. These contexts end at the word, so the bits of a
distinct word are scored once.

Words. A word that training has is also predicted by its exact count.

Running text. Each word stands behind another (a document's first behind an end), and is predicted by
the exact count of that pair: P(w | v) = s c(v, w) / c(v) + (1 - s) P(w). The share s is a weight that a
gate picks by how often training has v and by how many words before were met behind theirs, so a
passage that repeats is recognised as one after a few words. The gates' weights are learned online over all
training text. P(w) = (c(w) + K spelled(w)) / (total + K), where K leaves to unseen words the share of those met once.

Counts of words and pairs are exact tables of the whole corpus (pairs by 48 bits of a hash), so they grow
with it. A text that was learned from is scored with its own occurrence left out of them.

What travels are packed blocks. A batch of some millions of tokens keeps its distinct words and pairs in the order
of their hashes, sends each hash range its part, and gets counts back in the same order: some four bytes for a pair.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import crc_fold, drop, read, slices, written

#: Contexts: the last 1 to 4 bytes; log2 of the slots of each.
SLOTS = (17, 20, 22, 22)
ORDERS = len(SLOTS)
END = b"\n"
#: Added to either count before the log odds.
PRIOR = 0.3
STEPS = 33
#: Of learning weights, over the root of the summed squared slopes.
RATE = 0.03
BLOCK = 1 << 14
#: Tokens in a batch; entries of all batches in a range of words and of pairs; distinct words in a shard of the training.
BATCH_TOKENS = 4_000_000
RANGE_WORDS = 200_000
RANGE_PAIRS = 2_000_000
SHARD_WORDS = 500_000
CHUNK = 20_000
#: Words with more than this part of all occurrences are met in every step of the training.
HOT = 1000
KEY_BITS = 48

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def unit(word: bytes) -> bytes:
    return word + b" " if word else END


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


class Bits:
    """The bytes of some words' units with the base slot of each byte in each context."""

    def __init__(self, words: list[bytes]) -> None:
        units = [unit(w) for w in words]
        self.size = np.array([len(u) for u in units], np.int64)
        raw = np.frombuffer(b"".join(units), np.uint8)
        self.raw = raw.astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.size)
        begin = np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.at = np.arange(len(raw)) - begin
        wide = raw.astype(np.uint64) + np.uint64(1)
        self.base: list[np.ndarray] = []
        h = np.zeros(len(raw), np.uint64)
        for k in range(1, ORDERS + 1):
            past = np.zeros(len(raw), np.uint64)
            past[k:] = wide[:-k] if k < len(raw) else wide[:0]
            h = h * np.uint64(257) + np.where(self.at >= k, past, np.uint64(0))
            self.base.append(_mix(h * _Q + np.uint64(k)))

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bit's number, bits so far behind a leading one, the bit) for the eight bits of all bytes."""
        for j in range(8):
            yield j, (1 << j) | (self.raw >> (8 - j)), (self.raw >> (7 - j)) & 1

    def slot(self, k: int, node: np.ndarray) -> np.ndarray:
        mixed = (self.base[k] + node.astype(np.uint64) * _Q) * _P
        return (mixed >> np.uint64(64 - SLOTS[k])).astype(np.int64)


def count(words: list[bytes], weight: np.ndarray, into: list[np.ndarray]) -> None:
    """Adds the bits of words that occur ``weight`` times to the counts: an array (slot, bit), flat, of each context."""
    for a in range(0, len(words), CHUNK):
        bits = Bits(words[a : a + CHUNK])
        w = weight[a : a + CHUNK][bits.owner].astype(np.float64)
        for _, node, bit in bits.steps():
            for k in range(ORDERS):
                np.add.at(into[k], bits.slot(k, node) * 2 + bit, w)


#: Counts are kept in a byte: to 31 as they are, then in eighths of a doubling.
_EXACT = 32


def code(n: np.ndarray) -> np.ndarray:
    big = np.clip(_EXACT + np.floor(8 * np.log2(np.maximum(n, 1) / _EXACT)), _EXACT, 255)
    return np.where(n < _EXACT, n, big).astype(np.uint8)


_VALUE = np.concatenate([np.arange(_EXACT), _EXACT * 2 ** ((np.arange(_EXACT, 256) - _EXACT + 0.5) / 8)])
_N0, _N1 = _VALUE[np.arange(1 << 16) & 255], _VALUE[np.arange(1 << 16) >> 8]
#: By both codes: log odds, and how much was seen (0, 1, 2, 3-4, 5-8, ... : 16 levels).
ODDS = np.log((_N1 + PRIOR) / (_N0 + PRIOR)).astype(np.float32)
SEEN = np.clip(np.ceil(np.log2(np.maximum(_N0 + _N1, 0.5)) + 1), 0, 15).astype(np.int64)
GATES = 4 * 6 * 16


class Mixer:
    """Weights by gate and the adaptive map; ``pairs``: for each context both codes of each slot in 16 bits."""

    def __init__(self, pairs: list[np.ndarray]) -> None:
        self.pairs = pairs
        self.weights = np.full((GATES, ORDERS + 1), 1.0 / ORDERS)
        self.weights[:, -1] = 0
        self.slope = np.full((GATES, ORDERS + 1), 1e-9)
        middle = (np.arange(STEPS) - STEPS // 2) / 2
        self.came = np.tile(1 / (1 + np.exp(-middle)), (256, 1)) * 20
        self.met = np.full((256, STEPS), 20.0)

    def odds(self, bits: Bits, node: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by context and the gate; with a bit, one occurrence of it is left out."""
        x = np.empty((len(node), ORDERS + 1), np.float32)
        x[:, -1] = 0.3
        seen = []
        for k in range(ORDERS):
            pair = self.pairs[k][bits.slot(k, node)].astype(np.int64)
            if bit is not None:
                own = np.where(bit == 1, pair >> 8, pair & 255)
                pair = pair - np.where((own > 0) & (own < _EXACT), np.where(bit == 1, 256, 1), 0)
            x[:, k] = ODDS[pair]
            if k >= ORDERS - 2:
                seen.append(SEEN[pair])
        return x, (np.minimum(bits.at, 3) * 6 + np.minimum(seen[0] // 2, 5)) * 16 + seen[1]

    def refined(self, z: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of a one, the map's cell below, how far to the next)."""
        place = np.clip(z * 2 + STEPS // 2, 0, STEPS - 1.001)
        cell = place.astype(np.int64)
        part = place - cell
        rate = self.came / self.met
        mapped = rate[node, cell] * (1 - part) + rate[node, cell + 1] * part
        mixed = 1 / (1 + np.exp(-z))
        return np.clip((mixed + mapped) / 2, 1e-6, 1 - 1e-6), cell, part

    def learn(self, words: list[bytes], weight: np.ndarray, hot: list[bytes] = (), hot_weight: np.ndarray = (), rest: float = 1.0) -> None:
        """One pass in small steps. Words that are met often (``hot``) take part in each step by its share of
        the other words' ``rest`` occurrences, so that every step sees words as texts have them."""
        step = CHUNK // 4
        for a in range(0, len(words), step):
            own = weight[a : a + step].astype(np.float64)
            bits = Bits([*words[a : a + step], *hot])
            w = np.concatenate([own, np.asarray(hot_weight, np.float64) * (own.sum() / rest)])[bits.owner]
            w /= w.mean()
            for _, node, bit in bits.steps():
                x, gate = self.odds(bits, node, bit)
                z = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -30, 30)
                error = (bit - 1 / (1 + np.exp(-z))) * w
                for k in range(ORDERS + 1):
                    g = np.bincount(gate, error * x[:, k], GATES) / len(x)
                    self.slope[:, k] += g * g
                    self.weights[:, k] += RATE * g / np.sqrt(self.slope[:, k])
                _, cell, part = self.refined(z, node)
                for c, share in ((cell, 1 - part), (cell + 1, part)):
                    flat = node * STEPS + c
                    self.came += np.bincount(flat, w * share * bit, 256 * STEPS).reshape(256, STEPS)
                    self.met += np.bincount(flat, w * share, 256 * STEPS).reshape(256, STEPS)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        out = np.zeros(len(words))
        for a in range(0, len(words), CHUNK):
            bits = Bits(words[a : a + CHUNK])
            total = np.zeros(len(bits.raw))
            for _, node, bit in bits.steps():
                x, gate = self.odds(bits, node, None)
                z = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -30, 30)
                p, _, _ = self.refined(z, node)
                total += np.log10(np.where(bit == 1, p, 1 - p))
            out[a : a + CHUNK] = np.bincount(bits.owner, total, len(bits.size))
        return out


# --- the corpus -------------------------------------------------------------------------------------

_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes, kind: str = "S") -> np.ndarray | bytes:
    raw = _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    return raw if kind == "S" else np.frombuffer(raw, kind)


def _row(schema: str, *values) -> pa.RecordBatch:
    """One row of a Spark schema of long, int, binary and arrays of these."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as they may be large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), "<u8")


def _starts(hashes: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of ascending hashes begins, and the end."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


BATCH = "batch long, n_words long, n_tokens long, words binary, train binary, doc_ids array<long>, learns binary, sizes binary, n_bytes binary, ords binary"


def _batches(most: int):
    """Documents as numbers of words, some documents together: their distinct words by hash, training counts, and each document's words in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        words, docs, rows, sizes, n_bytes, learns = _Words(), [], array("I"), [], [], []

        def close() -> pa.RecordBatch:
            names = list(words)
            order = np.argsort(_hashes(names), kind="stable")
            place = np.empty(len(names), np.uint32)
            place[order] = np.arange(len(names), dtype=np.uint32)
            ords = place[np.frombuffer(rows, np.uint32)]
            learned = np.bincount(ords, np.repeat(np.array(learns, float), sizes), len(names)).astype("<i8")
            packed = [_packed(b"\n".join([names[k] for k in order.tolist()])), _packed(learned)]
            raw = [np.array(learns, np.uint8).tobytes(), np.array(sizes, "<u4").tobytes(), np.array(n_bytes, "<i8").tobytes(), _packed(ords)]
            return _row(BATCH, (part << 24) + made, len(names), len(ords), *packed, docs, *raw)

        for whole in batches:
            for some in slices(whole, "text"):
                for doc, text, learn in zip(*[some.column(c).to_pylist() for c in ("doc_id", "text", "learn")], strict=True):
                    own = (text or "").encode("utf-8", "replace").lower().split()
                    n_bytes.append(sum(map(len, own)) + len(own) + 1)
                    own.append(b"")
                    rows.extend(map(words.__getitem__, own))
                    docs.append(doc)
                    sizes.append(len(own))
                    learns.append(int(learn))
                    if len(rows) >= most:
                        yield close()
                        made += 1
                        words, docs, rows, sizes, n_bytes, learns = _Words(), [], array("I"), [], [], []
        if docs:
            yield close()

    return run


WORD_PART = "range int, batch long, words binary, train binary"
VOCAB = "range int, words binary, c binary, known long, once long, total long, batches array<long>, places array<binary>"


def _deal_words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names, train = _unpacked(row["words"]).split(b"\n"), _unpacked(row["train"], "<i8")
            at = _starts(_hashes(names), ranges).tolist()
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    yield _row(WORD_PART, k, row["batch"], _packed(b"\n".join(names[a:b])), _packed(train[a:b]))

    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each range; they come sorted."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0]["range"] != row["range"]:
            yield held[0]["range"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["range"], held


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's words with their counts over all batches, and where each batch's words stand in it."""
    for k, rows in _by_range(batches):
        words = _Words()
        places = [np.array([words[w] for w in _unpacked(r["words"]).split(b"\n")], "<u4") for r in rows]
        c = np.zeros(len(words), "<i8")
        for place, r in zip(places, rows, strict=True):
            c[place] += _unpacked(r["train"], "<i8")
        numbers = [int((c > 0).sum()), int((c == 1).sum()), int(c.sum())]
        yield _row(VOCAB, k, _packed(b"\n".join(words)), _packed(c), *numbers, [r["batch"] for r in rows], [_packed(p) for p in places])


def _known(row: dict) -> tuple[list[bytes], np.ndarray]:
    return _unpacked(row["words"]).split(b"\n"), _unpacked(row["c"], "<i8")


def _hot(often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, c = _known(row)
            some = np.flatnonzero(c > often).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in some], pa.binary()), pa.array(c[some], pa.int64())], names=["word", "c"])

    return run


COUNTS = "k int, block int, counts binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots that this task's words have touched, by blocks: places, zeros and ones."""
    tables = None
    for row in _rows(batches):
        words, c = _known(row)
        own = np.flatnonzero(c > 0)
        tables = tables or [np.zeros(2 << s) for s in SLOTS]
        count([words[k] for k in own.tolist()], c[own], tables)
    for k, table in enumerate(tables or ()):
        both = table.reshape(-1, 2)
        touched = np.flatnonzero(both.any(axis=1))
        for at in np.split(touched, np.flatnonzero(np.diff(touched // BLOCK)) + 1):
            if len(at):
                raw = (at % BLOCK).astype("<u2").tobytes() + both[at].astype("<u8").tobytes()
                yield _row(COUNTS, k, int(at[0]) // BLOCK, _packed(raw))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block, which come sorted; one block is held at a time."""
    at, total = None, None

    def made() -> pa.RecordBatch:
        pair = code(total[:, 0]).astype("<u2") | (code(total[:, 1]).astype("<u2") << 8)
        return _row("k int, block int, pairs binary", *at, _packed(pair.astype("<u2")))

    for row in _rows(batches):
        if at != (row["k"], row["block"]):
            if at is not None:
                yield made()
            at, total = (row["k"], row["block"]), np.zeros((min(1 << SLOTS[row["k"]], BLOCK), 2))
        raw = _unpacked(row["counts"])
        n = len(raw) // 18
        total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u8", 2 * n, 2 * n).reshape(n, 2)
    if at is not None:
        yield made()


def _learn(pairs, hot: list[bytes], hot_weight: np.ndarray, often: int, rest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, tokens = Mixer(pairs.value), 0
        came, met = mixer.came.copy(), mixer.met.copy()
        for row in _rows(batches):
            words, c = _known(row)
            own = np.flatnonzero((c > 0) & (c <= often))
            mixer.learn([words[k] for k in own.tolist()], c[own], hot, hot_weight, rest)
            tokens += int(c[own].sum())
        if tokens:
            yield _row("state binary", pickle.dumps((tokens, mixer.weights, mixer.came - came, mixer.met - met)))

    return run


RETURN = "batch long, is_pair int, range int, c binary, logp binary"


def _give_words(pairs, weights: np.ndarray, came: np.ndarray, met: np.ndarray):
    """Counts and spelling scores of each batch's words of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(pairs.value)
        mixer.weights, mixer.came, mixer.met = weights, came, met
        for row in _rows(batches):
            words, c = _known(row)
            logs = mixer.score(words).astype("<f4")
            for batch, place in zip(row["batches"], row["places"], strict=True):
                at = _unpacked(place, "<u4")
                yield _row(RETURN, batch, 0, row["range"], _packed(c[at]), _packed(logs[at]))

    return run


def _followed(ords: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each word and the one before it. Each document ends in the end, so that stands before the next one's first."""
    ords = ords.astype(np.int64)
    return np.concatenate([ords[-1:], ords[:-1]]) * distinct + ords


def pair_keys(hashes: np.ndarray, pair: np.ndarray) -> np.ndarray:
    before, word = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
    return _mix(_mix(before * _Q + np.uint64(7)) + word * _P) >> np.uint64(64 - KEY_BITS)


PAIR_PART = "range int, batch long, keys binary, train binary"


def _deal_pairs(ranges: int):
    """Each batch's distinct pairs by key: the steps from key to key, and how often training has the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, ords = _hashes(_unpacked(row["words"]).split(b"\n")), _unpacked(row["ords"], "<u4")
            learn = np.repeat(np.frombuffer(row["learns"], np.uint8), np.frombuffer(row["sizes"], "<u4")) > 0
            followed = _followed(ords, len(hashes))
            pair = np.unique(followed)
            trained, often = np.unique(followed[learn], return_counts=True)
            del followed, learn, ords
            train = np.zeros(len(pair), "<u4")
            train[np.searchsorted(pair, trained)] = often
            keys = pair_keys(hashes, pair)
            order = np.argsort(keys, kind="stable")
            keys, train = keys[order], train[order]
            at = _starts(keys, ranges, KEY_BITS).tolist()
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    steps = np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
                    yield _row(PAIR_PART, k, row["batch"], _packed(steps[:, : KEY_BITS // 8].T), _packed(train[a:b]))

    return run


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each batch the counts of its pairs of a range over all batches, in the order in which it sent them."""
    for k, rows in _by_range(batches):
        parts = []
        for r in rows:
            planes = _unpacked(r["keys"], "u1").reshape(KEY_BITS // 8, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, : KEY_BITS // 8] = planes.T
            parts.append(np.cumsum(steps.view("<u8").ravel()))
        keys, train = np.concatenate(parts), np.concatenate([_unpacked(r["train"], "<u4") for r in rows])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=np.uint64(1) << np.uint64(63)) != 0)
        sums = np.add.reduceat(train[order].astype(np.int64), first)
        c = np.empty(len(keys), "<u4")
        c[order] = np.repeat(np.minimum(sums, 0xFFFFFFFF), np.diff(first, append=len(keys)))
        ends = np.cumsum([len(p) for p in parts])
        for r, end, own in zip(rows, ends.tolist(), parts, strict=True):
            yield _row(RETURN, r["batch"], 1, k, _packed(c[end - len(own) : end]), b"")


JOINED = "batch long, doc_ids array<long>, learns binary, sizes binary, n_bytes binary, ords binary, c binary, logp binary, both binary"


def _join(texts: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """A batch's texts with the counts and scores of its words and, token by token, the counts of pairs."""
    names = [f.split()[0] for f in JOINED.split(", ")]
    if not len(texts):
        return pd.DataFrame({n: [] for n in names})
    row = texts.iloc[0]
    given = given.sort_values(["is_pair", "range"])
    words, pairs = given[given["is_pair"] == 0], given[given["is_pair"] == 1]
    c = np.concatenate([_unpacked(x, "<i8") for x in words["c"]])
    logp = np.concatenate([_unpacked(x, "<f4") for x in words["logp"]])
    hashes, ords = _hashes(_unpacked(row["words"]).split(b"\n")), _unpacked(row["ords"], "<u4")
    pair, at = np.unique(_followed(ords, len(hashes)), return_inverse=True)
    counts = np.empty(len(pair), "<u4")
    counts[np.argsort(pair_keys(hashes, pair), kind="stable")] = np.concatenate([_unpacked(x, "<u4") for x in pairs["c"]])
    values = [row["of"], row["doc_ids"], row["learns"], row["sizes"], row["n_bytes"], row["ords"], _packed(c), _packed(logp), _packed(counts[at])]
    return pd.DataFrame({n: [v] for n, v in zip(names, values, strict=True)})


#: Gates of running text: how often training has the word before (in halves of a doubling; 0: not at all), and of how
#: many words just before, RUN at most, the pair was known.
LEVELS = 40
RUN = 3


@dataclass
class Learned:
    """What scoring needs beside the counts: totals of words, K, the gates' weights, and the spelling model."""

    total: int
    distinct: int
    k: float
    share: np.ndarray
    mixer: Mixer

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 0.5) - np.log10(self.total + 0.5 * (self.distinct + 1))

    def parts(self, word: np.ndarray, before: np.ndarray, both: np.ndarray, run: np.ndarray, own: np.ndarray, c: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens: the gate, the pair's share of its first word, and log10 of the word's probability by itself. own: 1 in learned text."""
        seen, left = np.maximum(both - own, 0), np.maximum(c[before] - own, 0)
        alone, total = np.maximum(c[word] - own, 0), self.total - own
        spelled = np.log10(self.k) + logp[word]
        with np.errstate(divide="ignore"):
            single = np.where(alone > 0, np.log10(alone + 10 ** np.maximum(spelled, -300)), spelled) - np.log10(total + self.k)
        level = np.where(left > 0, np.minimum(1 + np.floor(2 * np.log2(np.maximum(left, 1))), LEVELS - 1), 0).astype(np.int64)
        return run * LEVELS + level, seen / np.maximum(left, 1), single

    def mixed(self, gate: np.ndarray, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
        s = self.share[gate]
        rest = np.log10(1 - s) + single
        with np.errstate(divide="ignore"):
            return np.where(pair > 0, np.log10(s * pair + 10 ** np.maximum(rest, -300)), rest)


def _runs(known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of how many tokens just before each one, RUN at most, the pair was known; none before a document's first."""
    out = np.zeros(len(known), np.int64)
    going = np.ones(len(known), bool)
    for k in range(1, RUN + 1):
        past = np.zeros(len(known), bool)
        past[k:] = known[:-k] if k < len(known) else known[:0]
        begin = np.zeros(len(known), bool)  # a document begins within the last k - 1 tokens or at this one
        begin[k - 1 :] = first[: len(first) - k + 1]
        going &= past & ~begin
        out += going
    return out


def _tokens(row: dict, model: Learned) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """parts() of a joined row's tokens, chunk by chunk."""
    ords, both = _unpacked(row["ords"], "<u4"), _unpacked(row["both"], "<u4")
    c, logp = _unpacked(row["c"], "<i8"), _unpacked(row["logp"], "<f4").astype(float)
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    own = np.repeat(np.frombuffer(row["learns"], np.uint8), sizes)
    first = np.zeros(len(ords), bool)
    first[np.cumsum(sizes) - sizes] = True
    run = _runs(both > own, first)
    before = np.concatenate([ords[-1:], ords[:-1]])
    for a in range(0, len(ords), CHUNK):
        at = slice(a, a + CHUNK)
        yield at, *model.parts(ords[at], before[at], both[at].astype(np.int64), run[at], own[at].astype(np.int64), c, logp), own[at] > 0


def _gates(model: Learned):
    """Online: each chunk's tokens are shared out by the weights as they stand, and the weights become the mean of all shares so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (RUN + 1) * LEVELS
        came, met = np.full(n, 1.0), np.full(n, 2.0)
        for row in _rows(batches):
            for _, gate, pair, single, own in _tokens(row, model):
                gate, pair, single = gate[own], pair[own], single[own]
                share = (came / met)[gate]
                by_pair = share * pair
                by_pair /= by_pair + (1 - share) * 10 ** np.maximum(single, -300)
                came += np.bincount(gate, by_pair, n)
                met += np.bincount(gate, minlength=n)
        yield _row("state binary", pickle.dumps((came - 1, met - 2)))

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _documents(model: Learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ords, c = _unpacked(row["ords"], "<u4"), _unpacked(row["c"], "<i8")
            score = np.empty(len(ords))
            for at, gate, pair, single, _ in _tokens(row, model):
                score[at] = model.mixed(gate, pair, single)
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            values = [row["doc_ids"], sizes, np.add.reduceat((c > 0).astype(np.int64)[ords], begin), np.add.reduceat(model.base(c)[ords], begin), np.add.reduceat(score, begin), np.frombuffer(row["n_bytes"], "<i8")]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in SCORES.split(", ")])

    return run


def _dealt(rows: DataFrame, run, schema: str, ranges: int) -> DataFrame:
    """Parts of each range in one partition, by batch."""
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, schema).repartition(min(ranges, 4 * partitions), "range").sortWithinPartitions("range", "batch")


def fit_and_score(docs: DataFrame, learn: str = "true", id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, range_words: int = RANGE_WORDS, range_pairs: int = RANGE_PAIRS) -> tuple[DataFrame, Learned]:
    """score_documents() and the model behind it."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))
    texts = written(rows.mapInArrow(_batches(batch_tokens), BATCH), "lm-texts")
    entries, tokens = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).head()
    ranges = max(partitions, -(-entries // range_words))
    parts = _dealt(texts.select("batch", "words", "train"), _deal_words(ranges), WORD_PART, ranges)
    vocab = written(parts.mapInArrow(_merge_words, VOCAB), "lm-words")
    distinct, once, total = vocab.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("known", "once", "total")]).head()
    # As many tasks as the words call for, as each has tables of one size.
    narrow = vocab.select("words", "c").coalesce(max(1, -(-distinct // SHARD_WORDS)))
    sums = narrow.mapInArrow(_counts, COUNTS).repartition(partitions, "k", "block").sortWithinPartitions("k", "block").mapInArrow(_merged, "k int, block int, pairs binary")
    tables = [np.zeros(1 << s, np.uint16) for s in SLOTS]
    for k, block, pairs in sums.collect():
        own = _unpacked(pairs, "<u2")
        tables[k][block * BLOCK : block * BLOCK + len(own)] = own
    shared = sc.broadcast(tables)  # of one size, whatever the corpus: about 19 MB
    mixer, often = Mixer(tables), total // HOT
    hot = vocab.select("words", "c").mapInArrow(_hot(often), "word binary, c long").collect()  # fewer than HOT words, as their counts add up to the total at most
    hot_weight = np.array([r["c"] for r in hot], float)
    if total > hot_weight.sum():
        learner = _learn(shared, [bytes(r["word"]) for r in hot], hot_weight, often, float(total - hot_weight.sum()))
    else:
        learner = _learn(shared, [], np.zeros(0), total, float(total or 1))
    states = [pickle.loads(r["state"]) for r in narrow.mapInArrow(learner, "state binary").collect()]
    if states:
        weight = np.array([s[0] for s in states], float)
        mixer.weights = np.einsum("s,sij->ij", weight / weight.sum(), np.array([s[1] for s in states]))
        mixer.came = mixer.came + sum(s[2] for s in states)
        mixer.met = mixer.met + sum(s[3] for s in states)
    given = vocab.select("range", "words", "c", "batches", "places").mapInArrow(_give_words(shared, mixer.weights, mixer.came, mixer.met), RETURN)
    ranges = max(partitions, -(-tokens // range_pairs))
    pairs = _dealt(texts.select("batch", "words", "learns", "sizes", "ords"), _deal_pairs(ranges), PAIR_PART, ranges)
    given = written(given.unionByName(pairs.mapInArrow(_merge_pairs, RETURN)), "lm-given")
    numbers = texts.withColumnRenamed("batch", "of").drop("train", "n_words", "n_tokens")
    joined = written(numbers.groupBy("of").cogroup(given.groupBy("batch")).applyInPandas(_join, JOINED), "lm-joined")
    for table in (texts, vocab, given):
        drop(table)
    k = max(1.0, once * total / max(1, total - once))
    model = Learned(int(total), int(distinct), float(k), np.zeros((RUN + 1) * LEVELS), Mixer([]))
    states = [pickle.loads(r["state"]) for r in joined.mapInArrow(_gates(model), "state binary").collect()]
    came, met = (sum(s[i] for s in states) if states else np.zeros(len(model.share)) for i in (0, 1))
    model.share = np.clip((came + 0.5) / (met + 1), 0, 0.9999)
    model.share[::LEVELS] = 0  # nothing is known behind a word that training hasn't
    bits = F.col("score") * (-np.log2(10.0)) / F.col("n_bytes")
    out = joined.mapInArrow(_documents(model), SCORES)
    out = out.select("doc_id", "n_tokens", "n_known", "base_score", "score", bits.alias("bits_per_byte"), F.lit(total).cast("long").alias("train_tokens"))
    model.mixer = mixer
    return out, model


def score_documents(docs: DataFrame, learn: str = "true", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text; learns from the rows for which the SQL condition ``learn`` holds.

    Returns one row for each row of docs: doc_id, n_tokens (words and the end), n_known (tokens met in
    training), base_score (log10 probability by smoothed word counts), score (the model's, of the words in their order),
    bits_per_byte (of the words with a blank behind each, and the end), train_tokens. A null text counts as empty and has the end alone. Ids may be null or
    repeated; repeated rows are scored alike, each of them learned from where ``learn`` holds. A text of any length is scored whole. With nothing to
    learn from, all bits are even. Further columns, whatever their names, are only seen by ``learn``. An empty table gives an empty result.
    """
    return fit_and_score(docs, learn, id_col, text_col)[0]


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold(F.col("doc_id")) != 1).alias("trains"))
    held_out = (crc_fold(F.col("doc_id")) == 1).alias("held_out")
    return score_documents(docs, "trains").select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
