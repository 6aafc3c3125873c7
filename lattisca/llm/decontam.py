"""Benchmark decontamination with an FM-index per shard of the training texts.

Each task packs its documents into shards of bounded size and indexes one shard at a time: suffix array, Burrows-Wheeler
transform, wavelet matrix and sampled suffix positions. All test phrases run through the index together by backward
search, their occurrences are located from the samples, and the word spans that they cover are merged per document.

Windows of one length have an index of their own, whose alphabet is the words of these windows. A word outside it cannot
be in a window, so each run of such words is one separator, and a run of words of the alphabet that is shorter than a
window is left out: neither changes an occurrence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattisca.llm.common import fresh, hash128, returns_memory, slices, spool

WINDOW = 13
#: Words of one index, and UTF-8 bytes of benchmark text that one broadcast holds; a larger benchmark is searched in blocks.
SHARD_WORDS = 1_500_000
BLOCK_BYTES = 4_000_000
SAMPLE = 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NAMES = ("n_words", "n_hit", "n_items", "items", "spans")
COLUMNS = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Bits:
    """A bit vector with constant-time rank: packed words and running counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, left = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << left) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: rank and access over a sequence of symbols, one bit vector a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            on = ((seq >> bit) & 1).astype(bool)
            self.levels.append(Bits(on))
            self.zeros.append(len(seq) - self.levels[-1].ones)
            seq = np.concatenate([seq[~on], seq[on]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before place i."""
        low, high = np.zeros_like(i), i.copy()
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            on = ((symbol >> (len(self.levels) - 1 - k)) & 1).astype(bool)
            a, b = bits.rank1(low), bits.rank1(high)
            low, high = np.where(on, zeros + a, low - a), np.where(on, zeros + b, high - b)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out, i = np.zeros_like(i), i.copy()
        for bits, zeros in zip(self.levels, self.zeros):
            on = bits.get(i).astype(bool)
            one = bits.rank1(i)
            out = out * 2 + on
            i = np.where(on, zeros + one, i - one)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq ends with a symbol that is smaller than all others."""
    rank, n, k = seq.astype(np.int64), len(seq), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FmIndex:
    """Counts and locates phrases in seq; symbols run from 1 to sigma - 1."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.bwt = Wavelet(seq[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))[:-1]])
        kept = order % sample == 0
        self.kept, self.samples, self.n = Bits(kept), order[kept], len(seq)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array for each phrase, all of one length: from low to high, empty where low >= high."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            go = np.flatnonzero(low < high)
            c = phrases[go, k]
            low[go], high[go] = self.less[c] + self.bwt.rank(c, low[go]), self.less[c] + self.bwt.rank(c, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position and add the steps taken."""
        out, at, left, steps = np.zeros_like(rows), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            found = self.kept.get(at).astype(bool)
            out[left[found]] = self.samples[self.kept.rank1(at[found])] + steps
            left, at = left[~found], at[~found]
            c = self.bwt.access(at)
            at, steps = self.less[c] + self.bwt.rank(c, at), steps + 1
        return out


class Phrases:
    """The windows of a block of benchmark items, as vocabulary ids by length, and the items that hold each; made once a block, in flat arrays.

    Each length has an alphabet of its own, the words of its windows, so that a short item doesn't draw other items' words into an index.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number, texts = {n: k for k, n in enumerate(self.names)}, []
        for item, text in items:
            words = words_of(text)
            texts.append((number[item], np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), dtype=np.int32, count=len(words))))
        self.by_length, first, owners, base = [], [np.zeros(1, dtype=np.int64)], [], 0
        for n in sorted({min(len(t), window) for _, t in texts} - {0}):
            own = [(i, t) for i, t in texts if min(len(t), window) == n]
            flat = np.concatenate([t for _, t in own])
            counts = np.array([len(t) - n + 1 for _, t in own])
            starts = np.arange(counts.sum()) + np.repeat(np.arange(len(own)) * (n - 1), counts)
            rows = np.ascontiguousarray(flat[starts[:, None] + np.arange(n)])
            distinct, which = np.unique(rows.view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(self.names) + np.repeat(np.array([i for i, _ in own]), counts))
            self.by_length.append((n, base, distinct.view(np.int32).reshape(-1, n)))
            first.append(np.searchsorted(pairs // len(self.names), np.arange(1, len(distinct) + 1)) + sum(map(len, owners)))
            owners.append(pairs % len(self.names))
            base += len(distinct)
        self.first, self.owners = np.concatenate(first), np.concatenate([np.zeros(0, dtype=np.int64), *owners])

    def items(self, numbers: np.ndarray) -> list[str]:
        """The items that hold any of the windows."""
        return [self.names[i] for i in np.unique(np.concatenate([self.owners[self.first[k] : self.first[k + 1]] for k in numbers.tolist()]))]

    def hits(self, ids: np.ndarray, doc: np.ndarray, sample: int = SAMPLE):
        """Occurrences in words with vocabulary ids (0: none) of documents: arrays of places, lengths and window numbers."""
        at, length, number = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
        for n, base, phrases in self.by_length if len(ids) else []:
            known = np.unique(phrases)
            symbol = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
            symbol[known] = np.arange(2, len(known) + 2)
            own = symbol[ids]
            inside = own > 0
            breaks = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])]))
            sizes = np.diff(np.append(breaks, len(ids)))
            runs = inside[breaks] & (sizes >= n)
            starts, sizes = breaks[runs], sizes[runs]
            if not len(starts):
                continue
            # Each run is followed by one separator, symbol 1.
            ends = np.cumsum(sizes + 1)
            place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes - 1), sizes + 1)
            seq = own[np.minimum(place, len(ids) - 1)]
            seq[ends - 1] = 1
            index = FmIndex(seq, len(known) + 2, sample)
            low, high = index.search(symbol[phrases])
            which = np.flatnonzero(high > low)
            counts = (high - low)[which]
            rows = np.arange(int(counts.sum())) + np.repeat(low[which] - (np.cumsum(counts) - counts), counts)
            at.append(place[index.locate(rows)])
            length.append(np.full(len(rows), n))
            number.append(np.repeat(which, counts) + base)
        return np.concatenate(at), np.concatenate(length), np.concatenate(number)


def _found(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Number of words, merged word spans and items of each text."""
    get, ids, sizes = phrases.vocabulary.get, [], []
    for text in texts:
        words = words_of(text) if text else []
        sizes.append(len(words))
        ids.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
    ends = np.cumsum(sizes, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at, length, number = phrases.hits(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), doc)
    out: list = [(n, [], []) for n in sizes]
    if len(at):
        order = np.argsort(at, kind="stable")
        at, length, number = at[order], length[order], number[order]
        of = doc[at]
        stop = np.zeros(len(at), dtype=np.int64)
        for a, b in _groups(of):
            stop[a:b] = np.maximum.accumulate(at[a:b] + length[a:b])
            d, base = int(of[a]), int(ends[of[a]] - sizes[of[a]])
            fresh = np.flatnonzero(np.concatenate([[True], at[a + 1 : b] > stop[a : b - 1]])) + a
            last = np.append(fresh[1:], b) - 1
            out[d] = (sizes[d], [(int(x) - base, int(y) - base) for x, y in zip(at[fresh], stop[last])], phrases.items(np.unique(number[a:b])))
    return out


def _groups(of: np.ndarray):
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct rows in parts of about block_bytes: one sum is all that the driver sees before it takes a part. A text longer than that is in one part."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    return [rows] if n <= 1 else [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _shards(batches, shard_words: int):
    """Rows of a task in shards of about so many words (four bytes each)."""
    waiting, held = [], 0
    for batch in batches:
        for part in slices(batch):
            waiting.append(part)
            held += sum(len(x) for x in part.column("text").cast(pa.binary()).to_pylist() if x) // 4
            if held >= shard_words:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items and spans of covered words (start inclusive, stop exclusive); cut: text loses the spans.

    Words are runs of digits, letters and bytes over 0x7F, A-Z in lower case. A window is 13 words of an item, or all
    words of a shorter one. A null or empty text has no words and no hits; an item without words has no window, and a
    null item_id counts as no item but its windows still cover words. Repeated rows and items each count once per row;
    an empty benchmark finds nothing, an empty table gives no rows. Texts of any length are searched whole. Input columns
    keep their values; those named like an output are replaced.

    A benchmark of one block is searched in one pass. A larger one takes a pass a block: only the rows with hits are
    written, by hash of the text, and the block's windows are dropped everywhere before the next are sent.
    """
    sc, out = docs.sparkSession.sparkContext, docs.drop(*NAMES)
    schema = StructType(out.schema.fields + StructType.fromDDL(COLUMNS).fields)

    def phrases(block):
        return sc.broadcast(Phrases([(r["item_id"] if r["item_id"] is not None else "", r["text"].encode()) for r in block.collect()], window))

    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        held = phrases(blocks[0])

        @returns_memory
        def search(batches):
            for table in _shards(batches, shard_words):
                yield from _answered(table, _found(table["text"].cast(pa.binary()).to_pylist(), held.value), cut)

        return out.mapInArrow(search, schema)

    hits, key = None, hash128("text")
    for k, block in enumerate(blocks):
        held = phrases(block)

        @returns_memory
        def hit(batches, held=held):
            for table in _shards(batches, shard_words):
                found = _found(table["text"].cast(pa.binary()).to_pylist(), held.value)
                some = [i for i, (_, spans, _) in enumerate(found) if spans]
                yield from table.select(["a", "b"]).take(pa.array(some, pa.int64())).append_column("items", pa.array([found[i][2] for i in some], pa.list_(pa.string()))).append_column("spans", _spans([found[i][1] for i in some])).combine_chunks().to_batches()

        own = docs.select(key.alias("k"), "text").select("k.a", "k.b", "text").mapInArrow(hit, "a bigint, b bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>")
        own = spool(own, "hits").withColumn("block", F.lit(k))
        held.destroy()
        hits = own if hits is None else hits.unionByName(own)
    a, b = fresh(out, "a", "b")
    each = hits.dropDuplicates(["a", "b", "block"]).groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = out.withColumns({a: key["a"], b: key["b"]}).join(each, [a, b], "left").drop(a, b)

    @returns_memory
    def finish(batches):
        for batch in batches:
            for part in slices(batch):
                found = []
                for text, items, spans in zip(*(part.column(c).to_pylist() for c in ("text", "items", "spans"))):
                    found.append((len(words_of(text.encode())) if text else 0, merge([(s["start"], s["stop"]) for s in spans or []]), sorted(set(items or []))))
                yield from _answered(pa.Table.from_batches([part]).drop_columns(["items", "spans"]), found, cut)

    return joined.mapInArrow(finish, schema)


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))


def _answered(table: pa.Table, found: list[tuple[int, list[tuple[int, int]], list[str]]], cut: bool):
    columns = [
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64()),
        pa.array([len(i) - ("" in i) for _, _, i in found], pa.int64()),
        pa.array([i for _, _, i in found], pa.list_(pa.string())),
        _spans([s for _, s, _ in found]),
    ]
    for name, column in zip(NAMES, columns):
        table = table.append_column(name, column)
    if cut:
        i = table.schema.get_field_index("text")
        texts = [cut_spans(t, x) if x else t for t, (_, x, _) in zip(table["text"].to_pylist(), found)]
        table = table.set_column(i, table.schema.field(i), pa.array(texts, table.schema.field(i).type))
    yield from table.combine_chunks().to_batches(max_chunksize=2048)


def contaminated():
    """A document is contaminated where at least one word in 20 is covered."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(found: DataFrame) -> DataFrame:
    """The per-document digest of find_phrases()."""
    joined = F.array_join(F.filter("items", lambda i: i != ""), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), contaminated().alias("contaminated"), "spans")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(_FOLD))]
    for a, b in reversed(spans):
        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
    return raw.decode()
