"""Token-ID binary output (operator 5): directly addressable codes.

Every id is cut into chunks of 8 bits. Level k holds the k-th chunk of all ids that have one, and a
bitmap with a 1 where the id goes on in level k + 1. A rank directory (ones before every block of 512
bits) tells where in the next level it goes on, so any single id is read from a few bytes without
decoding its neighbours. A shard is one self-contained byte string:

    magic 'DAC1' | u32 documents | u64 tokens | u32 levels
    u64 document ends (tokens up to and including the document), one a document
    i64 document ids, one a document; u8 1 where the id is null, one a document
    a level: u64 chunks | chunk bytes | bitmap bytes | u32 ones before each 512 bits

Shards are the rows of a Parquet table in ascending document order, so that Spark's own writer
commits them and any store Spark can reach can hold them.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path
from .words import texts

MAGIC = b"DAC1"
BLOCK = 512
END_ID = 1
#: A shard is closed once it holds so many ids; a longer document still goes into one shard.
SHARD_TOKENS = 250_000


def encode_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard of the documents' id arrays (unsigned 32-bit), in the order given."""
    flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.uint32)
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    out, level, levels = [], flat, 0
    while True:
        more = level > 0xFF
        out += [np.uint64(len(level)).tobytes(), (level & 0xFF).astype(np.uint8).tobytes(), *_bitmap(more)]
        levels += 1
        if not more.any():
            break
        level = level[more] >> np.uint32(8)
    head = [MAGIC, np.uint32(len(ids)).tobytes(), np.uint64(len(flat)).tobytes(), np.uint32(levels).tobytes()]
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes()
    return b"".join([*head, ends.tobytes(), keys, nulls, *out])


def _bitmap(bits: np.ndarray) -> list[bytes]:
    size = -(-max(len(bits), 1) // BLOCK) * BLOCK
    padded = np.zeros(size, dtype=bool)
    padded[: len(bits)] = bits
    ones = padded.reshape(-1, BLOCK).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
    return [np.packbits(padded, bitorder="little").tobytes(), before.tobytes()]


class Shard:
    """Reads a shard: whole documents at once, or any single id by rank."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs = int(np.frombuffer(payload, "<u4", 1, 4)[0])
        self.n_tokens = int(np.frombuffer(payload, "<u8", 1, 8)[0])
        levels, at = int(np.frombuffer(payload, "<u4", 1, 16)[0]), 20
        self.ends = np.frombuffer(payload, "<u8", self.n_docs, at).astype(np.int64)
        keys = np.frombuffer(payload, "<i8", self.n_docs, at + 8 * self.n_docs)
        nulls = np.frombuffer(payload, np.uint8, self.n_docs, at + 16 * self.n_docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        at += 17 * self.n_docs
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            blocks = -(-max(n, 1) // BLOCK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + 8 + n)
            rank = np.frombuffer(payload, "<u4", blocks, at + 8 + n + blocks * BLOCK // 8)
            self.levels.append((chunks, bits, rank))
            at += 8 + n + blocks * BLOCK // 8 + 4 * blocks

    def token(self, i: int) -> int:
        """The i-th id of the shard; touches one byte, one bit and part of one block a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(rank[block]) + int(before[: i - block * BLOCK].sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        values, at, shift = np.zeros(self.n_tokens, dtype=np.uint32), np.arange(self.n_tokens), 0
        for chunks, bits, _ in self.levels:
            values[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            at = at[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
            shift += 8
        return values


#: Latin letters that neither Unicode composition nor case mapping changes in number, then plain marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")


class PieceCache(dict):
    """Piece between spaces -> its ids as little-endian bytes.

    Where the vocabulary's pre-tokenizer drops white space and never joins across it, a text's ids are its
    pieces' ids in a row; of other vocabularies whole texts are encoded. Plain words skip the normalizer:
    their lower-case bytes go straight to the model.
    """

    LIMIT, WORDS = 600_000, 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.by_model = self._agrees()
        self.by_piece = self.by_model or self._drops_space()

    def whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def by_bytes(self, word: str) -> bytes:
        mapped = "".join(map(_BYTE_CHARS.__getitem__, word.lower().encode()))
        return np.array([x.id for x in self.tokenizer.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _agrees(self) -> bool:
        """Whether the direct way equals the library's own for this vocabulary."""
        probe = ["The", "thing", "ÈTRE", "müßte", "niño", "chlichkeit", "ningthation"]
        try:
            return all(self.by_bytes(x) == self.whole(x) and self.whole(f"{x}., {x}") == self.whole(x) + self.whole(".,") + self.whole(x) for x in probe)
        except Exception:  # noqa: BLE001  a vocabulary of another kind: encode every piece the long way
            return False

    def _drops_space(self) -> bool:
        probe = ["The thing", "a  b\nc", "x.\ty 12"]
        return all(self.whole(x) == b"".join(map(self.whole, x.replace("\n", " ").split(" "))) for x in probe)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        plain = self.by_model and _PLAIN.fullmatch(piece)
        if plain:
            word, marks = plain.groups()
            value = self.word(word)
            if marks:
                value += self.words.get(marks) or self.words.setdefault(marks, self.whole(marks))
        else:
            value = self.whole(piece)
        self[piece] = value
        return value

    def word(self, word: str) -> bytes:
        value = self.words.get(word)
        if value is None:
            if len(self.words) >= self.WORDS:
                self.words.clear()
            value = self.words[word] = self.by_bytes(word)
        return value

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def piece_cache(path: str) -> PieceCache:
    """One cache a worker process, kept from task to task."""
    return PieceCache(path)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, partitions: int | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encodes all documents in ascending doc_id order (nulls first; equal ids by text) and writes the
    shards as a Parquet table; returns its path. Columns: part, seq, before (ids in earlier shards of the
    part), n_docs, n_tokens, payload. Null text counts as empty: only the end id is written.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, end = piece_cache(tokenizer_path), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        seq = before = size = 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_docs": [len(ids)], "n_tokens": [size], "payload": [encode_shard(keys, ids)]}, schema=_SHARDS)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                keys.append(key)
                ids.append(np.frombuffer(cache.encode(text.decode("utf-8", "replace")) + end, dtype="<u4"))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard()
                    seq, before, size, ids, keys = seq + 1, before + size, 0, [], []
        if ids:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.transform(map_arrow, encode, "part int, seq long, before long, n_docs long, n_tokens long, payload binary").write.parquet(path)
    return path


_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark, path: str) -> DataFrame:
    """Reads the shards back: a row per document with doc_id, start (ids before it in the whole table),
    n_tokens and ids_crc32. Only the ids per part, one number a partition, come to the driver."""
    shards = spark.read.parquet(path)
    starts, total = {}, 0
    for part, size in sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + size

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard, first = Shard(payload), starts[part] + before
                ids, begins = shard.all().astype("<u4"), np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, shard.ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": shard.doc_ids, "start": first + begins, "n_tokens": shard.ends - begins, "ids_crc32": sums}, schema=_DIGESTS)

    return shards.select("part", "before", "payload").transform(map_arrow, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes the token files and reads them back; an empty table gives no rows."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer_path, path, **options))
