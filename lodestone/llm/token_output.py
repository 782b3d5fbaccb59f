"""Token ids in Simple-8b files.

A file is a run of rows written by Spark (so commits are atomic and lost tasks are simply redone).
Each row is one self-contained shard image in ``image``:

    magic b"LS8B", version u32, n_docs u32, n_ids u32, n_blocks u32, n_words u32, n_escapes u32, 0 u32
    doc_len   u32 x n_docs     ids of each document
    block_at  u32 x n_blocks   first word of each block of BLOCK ids
    escape_at u32 x n_escapes, then escape u64 x n_escapes (8-byte aligned)
    words     u64 x n_words

A word has its selector in the top 4 bits and equally wide ids in the low 60, first id lowest. The
selectors are in COUNTS and WIDTHS. Selector 0 is an escape: one value of more than 60 bits, which is
found in the escape list by the word's payload. A block starts on a word of its own, so all blocks
decode side by side; its last word is padded with zeros, which the known number of ids cuts off.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import read, shared_dir, slices

MAGIC = b"LS8B"
BLOCK = 512
#: Selectors 1 to 14: ids in a word, and their width in bits (fixed values of the coding).
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
WIDTHS = tuple(60 // n for n in COUNTS)
#: A shard is closed at so many ids, and so at most one document more.
SHARD_IDS = 1 << 20


#: Bits of 16-bit values, 1 at least.
_BITS16 = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if not len(values) or values.max() < 1 << 16:
        return _BITS16[values]
    out = np.ones(len(values), np.uint8)
    for k in range(4):
        part = (values >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _BITS16[part] + np.uint8(16 * k), out)
    return out


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block_at, words, escape_at, escapes) of unsigned 64-bit values.

    The widest of the next 2, 3, ... 60 ids is a running maximum over all places at once, which gives
    each place the most ids that a word begun there can hold. All blocks then hop from word to word
    side by side. Past a block's end stand zeros.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    lanes = -(-n // block)
    if not n:
        none = np.zeros(0, np.uint64)
        return none.astype(np.uint32), none, none.astype(np.uint32), none
    row = block + COUNTS[-1]
    grid = np.zeros((lanes, row), np.uint64)
    whole = np.zeros(lanes * block, np.uint64)
    whole[:n] = values
    grid[:, :block] = whole.reshape(lanes, block)
    grid = grid.ravel()
    widest = _bits(grid)
    bits = widest.copy()
    selector = (bits <= WIDTHS[0]).astype(np.uint8)
    last = 1
    for count, width in zip(COUNTS[1:], WIDTHS[1:], strict=True):
        for k in range(last, count):
            np.maximum(widest[:-k], bits[k:], out=widest[:-k])
        last = count
        selector += widest <= width  # what fits here fits every selector before
    step = np.array((1, *COUNTS), np.int64)[selector]
    at = np.arange(lanes) * row
    ends = at + np.minimum(block, n - np.arange(lanes) * block)
    visited = np.zeros(len(grid), bool)
    while len(at):
        visited[at] = True
        at = at + step[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    begin = np.flatnonzero(visited)
    owner = begin // row
    block_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=lanes))[:-1]]).astype(np.uint32)
    chosen = selector[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen[chosen > 0]):
        own = np.flatnonzero(chosen == s)
        payload = np.zeros(len(own), np.uint64)
        for k in range(COUNTS[s - 1]):
            payload |= grid[begin[own] + k] << np.uint64(k * WIDTHS[s - 1])
        words[own] |= payload
    wide = np.flatnonzero(chosen == 0)
    words[wide] = np.arange(len(wide), dtype=np.uint64)
    return block_at, words, owner[wide].astype(np.uint32), grid[begin[wide]]


def unpack(n: int, block_at: np.ndarray, words: np.ndarray, escapes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n values back; one pass for each selector over all its words."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    counts = np.array((1, *COUNTS))[selector]
    ends = np.cumsum(counts)
    at = ends - counts
    sizes = np.minimum(block, n - np.arange(len(block_at)) * block)
    owner = np.repeat(np.arange(len(block_at)), np.diff(np.append(block_at, len(words)).astype(np.int64)))
    to = at - at[block_at.astype(np.int64)][owner] + owner * block
    limit = owner * block + sizes[owner]
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[to[own]] = escapes[payload[own].astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[s - 1]) - 1)
        for k in range(COUNTS[s - 1]):
            q = to[own] + k
            ok = q < limit[own]
            out[q[ok]] = (payload[own][ok] >> np.uint64(k * WIDTHS[s - 1])) & mask
    return out


def to_image(ids: np.ndarray, doc_len: np.ndarray) -> bytes:
    block_at, words, escape_at, escapes = pack(ids)
    head = np.array([1, len(doc_len), len(ids), len(block_at), len(words), len(escapes), 0], "<u4").tobytes()
    tables = b"".join(x.astype("<u4").tobytes() for x in (doc_len, block_at, escape_at))
    tables += b"\0" * (-(len(tables) + len(head) + 4) % 8)
    return MAGIC + head + tables + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def from_image(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, doc_len) of a shard image."""
    if image[:4] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    _, n_docs, n, n_blocks, n_words, n_escapes, _ = np.frombuffer(image, "<u4", 7, 4).tolist()
    doc_len = np.frombuffer(image, "<u4", n_docs, 32)
    block_at = np.frombuffer(image, "<u4", n_blocks, 32 + 4 * n_docs)
    at = 32 + 4 * (n_docs + n_blocks + n_escapes)
    at += -at % 8
    escapes = np.frombuffer(image, "<u8", n_escapes, at)
    words = np.frombuffer(image, "<u8", n_words, at + 8 * n_escapes)
    return unpack(n, block_at, words, escapes), doc_len


# --- tokenizing -------------------------------------------------------------------------------------

#: A worker forgets its pieces when so many are known.
MOST_PIECES = 1_200_000


#: White space by any of the libraries' rules, and what would join it to a blank.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))
MARKS = ".,;:!?"


class _Pieces(dict):
    """Piece of text -> row of the id table; an unknown piece gets a row at once and is encoded later."""

    def __init__(self, rows: list[int]) -> None:
        self.rows = rows
        self.new: list[str] = []
        self.new_rows: list[int] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = k = self.rows[0]
        self.rows[0] = k + 1
        self.new.append(piece)
        self.new_rows.append(k)
        return k

    def taken(self) -> tuple[list[str], list[int]]:
        out = self.new, self.new_rows
        self.new, self.new_rows = [], []
        return out


class PieceEncoder:
    """Encodes whole texts with a ``tokenizers`` byte-level BPE file, each distinct piece once, and an end id.

    The file's pre-tokenizer never joins text across a single blank that stands between two
    characters that aren't white space, and makes a single newline there a token of its own. So a text
    is cut at such blanks and newlines, and the ids of its pieces are those of the whole text; new
    pieces go to the library many at a time, newlines between them. Where white space adjoins a blank
    the parts stay together. Strings of special tokens become their ids as the library makes them: it
    takes them out first, so what stands between them is encoded by itself; where a special token also
    takes white space beside it or whole words only, a text that has it goes to the library whole.
    """

    JOINED = 200

    def __init__(self, path: str, end_id: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in sorted(added.items(), reverse=True) if t.content}
        longest = sorted(self.added, key=lambda c: (-len(c), c))
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.plain_cut = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: Marks that the pre-tokenizer parts from a letter before them at the end of a piece.
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in MARKS}
        self.reset()

    def reset(self) -> None:
        #: Row 0 is the end id, row 1 a newline, then the special tokens. Pieces at a line's begin, pieces that
        #: follow a blank (which their keys leave out), and pieces with white space in them.
        self.ids = np.array([self.end_id, self.newline, *self.added.values()], np.uint32)
        self.special = {c: 2 + k for k, c in enumerate(self.added)}
        rows = [len(self.ids)]
        self.plain, self.after, self.spaced = _Pieces(rows), _Pieces(rows), _Pieces(rows)
        self.begin, self.size = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)

    def text(self, text: str, rows: list[int]) -> None:
        """Adds the rows of a whole text."""
        if self.cut is None or not self.cut.search(text):
            self.pieces(text, rows)
        elif self.plain_cut:
            for part in self.cut.split(text):
                if part in self.special:
                    rows.append(self.special[part])
                elif part:
                    self.pieces(part, rows)
        else:
            rows.append(self.spaced[text])

    def pieces(self, text: str, rows: list[int]) -> None:
        """Adds the rows of a text's pieces."""
        # What is printable has no white space but blanks.
        simple = text[0] not in " \n" and text[-1] not in " \n" and text.replace("\n", "").isprintable()
        if simple and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text):
            for k, line in enumerate(text.split("\n")):
                if k:
                    rows.append(1)
                parts = line.split(" ")
                rows.append(self.plain[parts[0]])
                rows.extend(map(self.after.__getitem__, parts[1:]))
            return
        parts = text.split(" ")
        joined = [parts[0]]
        for part in parts[1:]:
            if not part or not joined[-1] or joined[-1][-1] in SPACES or part[0] in SPACES:
                joined[-1] = f"{joined[-1]} {part}"
            else:
                joined.append(" " + part)
        rows.extend(map(self.spaced.__getitem__, joined))

    def learn(self) -> None:
        """Encodes the new pieces; a word with a mark behind it is put together from both."""
        after = self.after
        joined = [k for k, p in enumerate(after.new) if p[-1] in MARKS and p[-2:-1].isalpha()]
        marked = [after.new[k] for k in joined]
        marked_rows = [after.new_rows[k] for k in joined]
        base = [after[p[:-1]] for p in marked]
        words, rows = after.taken()
        out = set(joined)
        easy = [" " + p for k, p in enumerate(words) if k not in out]
        easy_rows = [r for k, r in enumerate(rows) if k not in out]
        words, rows = self.plain.taken()
        easy += words
        easy_rows += rows
        hard, hard_rows = self.spaced.taken()
        packs = ["\n".join(easy[k : k + self.JOINED]) for k in range(0, len(easy), self.JOINED)]
        found = self.tokenizer.encode_batch_fast(packs + hard, add_special_tokens=False)
        between = np.array([self.newline], np.uint32)
        flat = [x for e in found[: len(packs)] for x in (np.array(e.ids, np.uint32), between)]
        ids = np.concatenate(flat) if flat else between[:0]
        ends = np.flatnonzero(ids == self.newline)
        own = [np.array(e.ids, np.uint32) for e in found[len(packs) :]]
        first, n = len(self.ids), self.plain.rows[0]
        begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        begin[: len(self.begin)], size[: len(self.size)] = self.begin, self.size
        if len(ends):
            start = np.concatenate([[0], ends[:-1] + 1])
            begin[easy_rows], size[easy_rows] = first + start, ends - start
        size[hard_rows] = [len(x) for x in own]
        begin[hard_rows] = first + len(ids) + np.cumsum(size[hard_rows]) - size[hard_rows]
        self.ids = np.concatenate([self.ids, ids, *own])
        if marked:
            tails = [self.marks[p[-1]] for p in marked]
            lead, tail = size[base], np.array([len(t) for t in tails])
            both = lead + tail
            made = np.zeros(both.sum(), np.uint32)
            at = np.cumsum(both) - both
            of_tail = np.arange(len(made)) - np.repeat(at, both) >= np.repeat(lead, both)
            made[~of_tail] = self.ids[np.arange(lead.sum()) + np.repeat(begin[base] - (np.cumsum(lead) - lead), lead)]
            made[of_tail] = [i for t in tails for i in t]
            begin[marked_rows], size[marked_rows] = len(self.ids) + at, both
            self.ids = np.concatenate([self.ids, made])
        self.begin, self.size = begin, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, doc_len) of the texts, an end id behind each."""
        if len(self.size) > MOST_PIECES:
            self.reset()
        rows: list[int] = []
        ends = []
        for text in texts:
            if text:
                self.text(text, rows)
            rows.append(0)
            ends.append(len(rows))
        if self.plain.rows[0] > len(self.size):
            self.learn()
        row = np.array(rows, np.int32)
        begin, size = self.begin[row], self.size[row]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        take = np.arange(total, dtype=np.int32) + np.repeat((begin - (upto - size)).astype(np.int32), size)
        doc_ends = upto[np.array(ends, np.int64) - 1]
        return self.ids[take], np.diff(doc_ends, prepend=0)


#: Kept from task to task by a Python worker that is used again.
ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder_of(path: str, end_id: int) -> PieceEncoder:
    """By a module's function, as what a task's closure holds is a copy."""
    if (path, end_id) not in ENCODERS:
        ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return ENCODERS[path, end_id]


SHARD_SCHEMA = "part int, shard int, n_ids long, n_docs long, doc_ids array<bigint>, image binary"


def _shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path, end_id)
        part, shard = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            image = to_image(np.concatenate(ids), np.concatenate(lens))
            columns = [[part], [shard], [held], [len(docs)], [docs], [image]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "shard", "n_ids", "n_docs", "doc_ids", "image"])

        for whole in batches:
            for batch in slices(whole, "text"):
                got, n = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                docs += batch.column("doc_id").to_pylist()
                ids.append(got)
                lens.append(n)
                held += len(got)
                if held >= SHARD_IDS:
                    yield close()
                    shard, docs, ids, lens, held = shard + 1, [], [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts to ``path`` in ascending id order, each document with end_id behind it.

    Null and empty texts have only the end id. Null ids come first; rows with equal ids stand in the
    order of their texts; further columns of any name are ignored. Rows are dealt by ranges of the id, so the files' (part, shard) order is the
    documents' order, and a task holds one shard at a time. An empty table makes an empty file.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    dealt.mapInArrow(_shards(tokenizer_path, end_id), SHARD_SCHEMA).write.option("compression", "none").parquet(path)


DECODED_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decode(firsts: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, docs, image in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, n = from_image(image)
                ends = np.cumsum(n.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                start = firsts[part, shard] + ends - n
                columns = [pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver gets one count for each shard of about a million ids, never anything for each document.
    """
    shards = spark.read.parquet(path)
    firsts, n = {}, 0
    for part, shard, k in sorted(shards.select("part", "shard", "n_ids").collect()):
        firsts[part, shard] = n
        n += k
    return shards.select("part", "shard", "doc_ids", "image").mapInArrow(_decode(firsts), DECODED_SCHEMA)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/lodestone/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
