"""SentencePiece encoding and decoding.

The pieces of a SentencePiece file stand in an Aho-Corasick automaton. One pass over a text, following
output links, meets every piece that ends at each position; each relaxes the best score there, and the
best path is read backwards (Viterbi). A character that is no piece becomes its UTF-8 bytes' pieces.

Pieces hold the blank mark only in front, so no path crosses a mark that follows another character;
texts are cut there, and each distinct chunk is encoded once in a worker.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import read, with_arrow

MARK = "▁"
#: Below the least score, a character without a piece costs so much more.
PENALTY = 10.0
#: A task forgets its chunks when so many are known, or when they have MEAN_IDS times as many ids.
MOST_CHUNKS = 500_000
MEAN_IDS = 16


class Pieces:
    """The pieces of a file: their text, score and automaton."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * n
        table: list[tuple[str, float, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                table.append((piece, sp.get_score(i), i))
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.table = table
        self.automaton = None

    #: A step over one character that becomes bytes.
    bytes_step = (0, 0.0, -1)

    def build(self) -> None:
        """Makes the automaton, which only encoding needs."""
        table = self.table
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in table:
            self.automaton.add_word(piece, (len(piece) - 1, score, i))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in table if len(p) == 1}
        self.unknown = min((s for _, s, _ in table), default=0.0) - PENALTY
        self.cuts = not any(MARK in p.lstrip(MARK) for p, _, _ in table)
        #: No piece crosses a place between two characters that aren't next to each other in any piece.
        self.pairs = {p[k : k + 2] for p, _, _ in table for k in range(len(p) - 1)}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over a text in which blanks are marks."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, float, int]] = [self.bytes_step] * (n + 1)
        if self.single.issuperset(text):
            for last, step in self.automaton.iter(text):
                s = best[last - step[0]] + step[1]
                if s > best[last + 1]:
                    best[last + 1] = s
                    back[last + 1] = step
        else:
            single, unknown = self.single, self.unknown
            bare = [p for p in range(n - 1, -1, -1) if text[p] not in single]
            for last, step in self.automaton.iter(text):
                while bare and bare[-1] < last:  # a character without a piece is stepped over before its followers are met
                    p = bare.pop()
                    if best[p] + unknown > best[p + 1]:
                        best[p + 1], back[p + 1] = best[p] + unknown, self.bytes_step
                s = best[last - step[0]] + step[1]
                if s > best[last + 1]:
                    best[last + 1], back[last + 1] = s, step
            for p in reversed(bare):
                if best[p] + unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + unknown, self.bytes_step
        out: list[int] = []
        p = n
        while p:
            size, _, i = back[p]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(text[p - 1 : p].encode())]
            else:
                out.append(i)
            p -= size + 1
        out.reverse()
        return out

    def encode_text(self, text: str) -> list[int]:
        """Ids of a whole text, uncut. A mark that is itself in the text is kept apart from blanks: it becomes bytes."""
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate(f" {text}".split(MARK)):
            if k:
                out += [self.byte_ids[b] for b in MARK.encode()]
            out += self.viterbi(part.replace(" ", MARK))
        return out

    def decode_text(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class _Chunks(dict):
    """Chunk -> row of the id table. What ends in characters that no piece joins to those before them is put together from the rest and them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.tails: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.at = array("i"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        pieces, n = self.pieces, len(chunk)
        if " " not in chunk:
            while n > 1 and chunk[n - 2 : n] not in pieces.pairs:
                n -= 1
        if n < len(chunk):
            row = self[chunk[:n]]  # no tail is left there, so this goes one step deep
            self.ids.extend(self.ids[self.at[row] : self.at[row + 1]])
            for tail in chunk[n:]:
                if tail not in self.tails:
                    self.tails[tail] = pieces.viterbi(tail)
                self.ids.extend(self.tails[tail])
        else:
            self.ids.extend(pieces.viterbi(MARK + chunk.replace(" ", MARK)))
        self[chunk] = k = len(self.at) - 1
        self.at.append(len(self.ids))
        return k


class Encoder:
    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS) -> None:
        self.pieces, self.most_chunks = built(path), most_chunks
        self.chunks = _Chunks(self.pieces)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Chunks of a text, each without its first blank (the first chunk's is the added one)."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, blanks = [], 0
        for part in parts:
            if part:
                out.append(" " * blanks + part)
                blanks = 0
            else:
                blanks += 1
        if blanks:
            out.append(" " * (blanks - 1))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        chunks = self.chunks
        if len(chunks) > self.most_chunks or len(chunks.ids) > MEAN_IDS * self.most_chunks:
            chunks.clear()
            self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        rows: list[int] = []
        sizes: list[int] = []
        plain: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            before = len(rows)
            if text and (MARK in text or not self.pieces.cuts):
                plain[k] = self.pieces.encode_text(text)
            elif text:
                rows.extend(map(chunks.__getitem__, self.parts(text)))
            sizes.append(len(rows) - before)
        if len(chunks.at) > len(self.at):
            self.ids = np.array(chunks.ids, np.int32)
            self.at = np.array(chunks.at, np.int64)
        row = np.array(rows, np.int32)
        size = self.at[row + 1] - self.at[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(self.at[row] - ends[:-1], size)
        ids, offsets = self.ids[take], ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        for k, own in sorted(plain.items(), reverse=True):
            ids = np.insert(ids, offsets[k], own)
        grown = np.zeros(len(texts) + 1, np.int64)
        for k, own in plain.items():
            grown[k + 1] = len(own)
        return ids, offsets + np.cumsum(grown)


#: Automata, kept from task to task by a Python worker that is used again; chunks go with their task.
BUILT: dict[str, Pieces] = {}


def built(path: str) -> Pieces:
    if path not in BUILT:
        BUILT[path] = Pieces(path)
        BUILT[path].build()
    return BUILT[path]


def encoding(model_path: str, most_chunks: int = MOST_CHUNKS):
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        own = Encoder(model_path, most_chunks)

        def convert(texts: pa.Array) -> list[pa.Array]:
            ids, offsets = own.encode(texts.to_pylist())
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pc.invert(texts.is_valid()))
            return [made]

        return convert

    return make


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """Adds the ids of each whole text; null stays null, an empty text has none. A column ids_col is replaced.

    Of paths of equal score that end at the same place, the one whose last piece is longest stays.
    """
    return with_arrow(docs, [text_col], f"`{ids_col}` array<int>", encoding(model_path))


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded", crc_col: str = "ids_crc32", most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """Adds ids, the text decoded from them, and the ids' crc32 (as little-endian 32-bit integers), in one pass of one worker.

    A task keeps at most about most_chunks chunks: fewer take less memory and more time.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encode, decode, crc = encoding(model_path, most_chunks)(), decoder(model_path)(), _crc()

        def convert(texts: pa.Array) -> list[pa.Array]:
            (ids,) = encode(texts)
            return [ids, *decode(ids), *crc(ids)]

        return convert

    return with_arrow(docs, [text_col], f"`{ids_col}` array<int>, `{decoded_col}` string, `{crc_col}` long", make)


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids: the very text that was encoded; ids without text (controls) give none. Null stays null."""

    return with_arrow(docs, [ids_col], f"`{text_col}` string", decoder(model_path))


def decoder(model_path: str):
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        raw = Pieces(model_path).raw
        blob = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        begin = np.cumsum(size) - size

        def convert(ids: pa.Array) -> list[pa.Array]:
            offsets = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            each = size[flat]
            upto = np.concatenate([[0], np.cumsum(each)])
            joined = blob[np.arange(upto[-1]) + np.repeat(begin[flat] - upto[:-1], each)].tobytes()
            ends = upto[offsets - offsets[0]].tolist()
            texts = []
            for a, b, valid in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True):
                a += joined[a : a + 1] == b" " and a < b  # the added blank
                texts.append(joined[a:b].decode("utf-8", "replace") if valid else None)
            return [pa.array(texts, pa.string())]

        return convert

    return make


def _crc() -> Callable[[pa.Array], list[pa.Array]]:
    def convert(ids: pa.Array) -> list[pa.Array]:
        ends = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        return [pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())]

    return convert


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode_and_decode(docs, path)
    n = F.size("piece_ids").cast("long").alias("n_ids")
    same = F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    return out.select("doc_id", n, "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same)
