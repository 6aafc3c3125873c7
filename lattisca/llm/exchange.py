"""Chunks of documents that ask hash buckets about keys, and get answers in the order they asked.

Millions of n-grams or windows a chunk would make millions of small rows. Instead each chunk of documents sends one row
of packed arrays to each bucket of the key space, a bucket's task answers each chunk with one packed row, and the answers
meet the chunk's documents again by chunk number. The chunks are written to the shared folder first, compressed, so every
pass sees the same documents in the same order and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm.common import spool

#: Bytes of text of a chunk and, of all texts, for each bucket. With much more data take more of both, so that their product of rows stays small.
CHUNK, BUCKET = 6_000_000, 10_000_000

Docs = list[tuple[int | None, bytes | None]]


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as compressed planes of bytes: those of high bytes, nearly all alike, cost next to nothing."""
    return squeeze(np.ascontiguousarray(values, dtype=np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys, as packed steps from one to the next."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def freeze(docs: Docs, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.large_binary())], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue(), level)


def thaw(data: bytes) -> Docs:
    table = pa.ipc.open_stream(unsqueeze(data)).read_all()
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def chunks(docs: DataFrame, apart: Callable[[int | None], bool] = lambda i: False, size: int = CHUNK, level: int = 1) -> DataFrame:
    """(chunk, bytes, main, other): docs in chunks of about ``size`` bytes, those whose id is ``apart`` in other; written to the shared folder.

    A text longer than size is a chunk of its own. level: of compression.
    """

    def packed(batches):
        at, n, total, main, other = TaskContext.get().partitionId() << 32, 0, 0, [], []
        schema = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("main", pa.binary()), ("other", pa.binary())])
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                (other if apart(i) else main).append((i, t))
                total += len(t or b"") + 16
                if total >= size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([at + n], [total], [freeze(main, level)], [freeze(other, level)]), schema)], schema=schema)
                    n, total, main, other = n + 1, 0, [], []
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([at + n], [total], [freeze(main, level)], [freeze(other, level)]), schema)], schema=schema)

    return spool(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(packed, "chunk bigint, bytes bigint, main binary, other binary"), "chunks")


def buckets_for(packed: DataFrame, size: int = BUCKET) -> int:
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    return max(24, -(-total // size))


class Words(dict):
    """XXH64 of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes; the order of a pair counts."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by doubling."""
    have, out, at = words, None, 0
    size = 1
    while size <= width:
        if width & size:
            out = have if out is None else mix(out[: len(words) - at - size + 1], have[at : len(words) - size + 1])
            at += size
        if 2 * size <= width:
            have = mix(have[: len(have) - size], have[size:])
        size *= 2
    return out[: len(words) - width + 1]


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in sorted keys: a bucket is a range of the 64-bit space."""
    step = 2**64 // buckets
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64(step)), [len(keys)]])


def rows(names: list[str], values: Iterator[tuple], kinds: list[pa.DataType], most: int = 8) -> Iterator[pa.RecordBatch]:
    """Record batches of a few packed rows each."""
    held = []
    for v in values:
        held.append(v)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def table(names: list[str], values: list[tuple], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*values) if values else [[]] * len(kinds), kinds)], names=names)
