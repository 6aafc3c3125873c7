"""Substring dedup with fixed-block anchors.

Each document's words are cut in non-overlapping reference blocks of 25 words, which are indexed; every rolling run of
25 words of every document probes the index. A repeated run of 50 words holds a whole block wherever it starts, so
blocks that several documents hold mark all places where repeats can be. From these anchors runs of 50 words are
compared by hash, each against the smallest document that holds it; the runs found, merged, are the maximal exact repeats.

Both questions (which blocks are shared; does a smaller document hold this run) are asked by chunks of documents and
answered by hash buckets, one bit an answer: no list of the holders of a block is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm import exchange as x
from lattisca.llm.common import spool

RUN = 50
_LOW = np.uint64(0xFFFFFFFF)


class Chunk:
    """Words and block-length runs of a chunk's documents. Documents without an id, or shorter than a run, have no runs."""

    def __init__(self, docs: x.Docs, run: int, known: x.Words):
        self.docs, self.run, self.block = docs, run, run // 2
        hashes, of, start, base = [], [], [], 0
        self.sizes = []
        for d, (i, text) in enumerate(docs):
            words = text.split() if text else []
            self.sizes.append(len(words))
            if i is not None and len(words) >= run:
                hashes.append(known.of(words))
                of.append(d)
        self.hashes, self.of = hashes, of

    def anchors(self, buckets: int):
        """Sorted keys of the distinct runs of block length (bucket number, then 32 bits of hash), which of the concatenated runs is which key, which keys are whole blocks, which keys two documents hold."""
        runs, doc, aligned = [], [], []
        for d, h in zip(self.of, self.hashes):
            w = x.windows(h, self.block)
            runs.append(w)
            doc.append(np.full(len(w), d))
            a = np.zeros(len(w), dtype=bool)
            a[:: self.block] = True
            aligned.append(a)
        if not runs:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none.astype(bool), none.astype(bool)
        runs, doc, aligned = np.concatenate(runs), np.concatenate(doc), np.concatenate(aligned)
        keys = ((runs >> np.uint64(32)) * np.uint64(buckets) & ~_LOW) | (runs & _LOW)
        distinct, number = np.unique(keys, return_inverse=True)
        whole = np.zeros(len(distinct), dtype=bool)
        whole[number[aligned]] = True
        low = np.full(len(distinct), len(self.docs))
        np.minimum.at(low, number, doc)
        several = np.zeros(len(distinct), dtype=bool)
        several[number[doc != low[number]]] = True
        return distinct, number, whole, several

    def candidates(self, shared: np.ndarray, number: np.ndarray):
        """Full runs around shared anchors: distinct keys, smallest document id of each, and per run its key number, document and place."""
        mark = shared[number] if len(number) else np.zeros(0, dtype=bool)
        keys, doc, place, at = [], [], [], 0
        for d, h in zip(self.of, self.hashes):
            n = len(h) - self.block + 1
            own, at = mark[at : at + n], at + n
            if not own.any():
                continue
            # A run from s holds the blocks that start at s to s + run - block.
            seen = np.concatenate([[0], np.cumsum(own)])
            s = np.arange(len(h) - self.run + 1)
            s = s[seen[s + self.run - self.block + 1] > seen[s]]
            keys.append(x.windows(h, self.run)[s])
            doc.append(np.full(len(s), d))
            place.append(s)
        if not keys:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, none, none
        keys, doc, place = np.concatenate(keys), np.concatenate(doc), np.concatenate(place)
        distinct, of_key = np.unique(keys, return_inverse=True)
        ids = np.array([i if i is not None else 0 for i, _ in self.docs], dtype=np.int64)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, of_key, ids[doc])
        return distinct, low, of_key, doc, place


def _bits(mask: np.ndarray) -> bytes:
    return x.squeeze(np.packbits(mask).tobytes())


def _mask(parts: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Bits of all buckets, in order, from (bucket, number, bits)."""
    return np.concatenate([np.zeros(0, dtype=bool), *[np.unpackbits(np.frombuffer(x.unsqueeze(b), dtype=np.uint8), count=n).astype(bool) for _, n, b in sorted(parts)]])


def remove_repeats(docs: DataFrame, run: int = RUN, chunk: int = x.CHUNK, bucket: int = x.BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces) and removed (spans of word places) of each row.

    Words are runs of anything but ASCII white space, unchanged. A word goes if it is covered by a run of 50 words that
    also starts in a document with a smaller doc_id; runs are judged on the input. Repeats inside one document and among
    rows of one doc_id stay. A null doc_id is neither smaller nor larger: such rows keep all words. Null and empty texts
    have no words. Repeated rows each get a row, an empty table none; other columns aren't read.
    """
    packed = x.chunks(docs, size=chunk)
    buckets = x.buckets_for(packed, bucket)

    def probe(batches):
        known = x.Words()

        def sent():
            for batch in batches:
                for number, main in zip(batch.column("chunk").to_pylist(), batch.column("main")):
                    keys, _, whole, several = Chunk(x.thaw(main.as_py()), run, known).anchors(buckets)
                    cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                    for k in range(buckets):
                        a, b = cut[k], cut[k + 1]
                        if b > a:
                            yield k, number, (keys[a:b] & _LOW).astype(np.uint32).tobytes(), _bits(whole[a:b]), _bits(several[a:b])

        yield from x.rows(["bucket", "chunk", "keys", "whole", "several"], sent(), [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def shared(part: pa.Table) -> pa.Table:
        asked = [(c, np.frombuffer(k, dtype=np.uint32), w, s) for c, k, w, s in zip(*(part[n].to_pylist() for n in ("chunk", "keys", "whole", "several")))]
        index = np.unique(np.concatenate([k[_mask([(0, len(k), w)])] for _, k, w, _ in asked]))
        holders, hits = np.zeros(len(index), dtype=np.int64), []
        for _, k, _, s in asked:
            at = np.searchsorted(index, k)
            hit = index[np.minimum(at, len(index) - 1)] == k if len(index) else np.zeros(len(k), dtype=bool)
            hits.append((at, hit))
            holders[at[hit]] += 1 + _mask([(0, len(k), s)])[hit]
        bucket = part["bucket"][0].as_py()
        out = []
        for (c, k, _, _), (at, hit) in zip(asked, hits):
            found = np.zeros(len(k), dtype=bool)
            found[hit] = holders[at[hit]] > 1
            out.append((c, bucket, 0, len(k), _bits(found)))
        return x.table(["chunk", "bucket", "kind", "n", "bits"], out, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    answer = "chunk bigint, bucket int, kind int, n int, bits binary"
    asked = packed.select("chunk", "main").mapInArrow(probe, "bucket int, chunk bigint, keys binary, whole binary, several binary")
    anchors = spool(asked.groupBy("bucket").applyInArrow(shared, answer), "anchors")

    def take(part: pa.Table, kind: int) -> np.ndarray:
        return _mask([(b, n, m) for b, k, n, m in zip(*(part[c].to_pylist() for c in ("bucket", "kind", "n", "bits"))) if k == kind])

    def extend(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            one = Chunk(x.thaw(own["main"][0].as_py()), run, x.Words())
            _, number, _, _ = one.anchors(buckets)
            keys, low, *_ = one.candidates(take(answers, 0), number)
            cut = x.edges(keys, buckets)
            out = [(k, own["chunk"][0].as_py(), keys[a:b].tobytes(), x.squeeze(low[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return x.table(["bucket", "chunk", "keys", "low"], out, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def smaller(part: pa.Table) -> pa.Table:
        asked = [(c, np.frombuffer(k, dtype=np.uint64), np.frombuffer(x.unsqueeze(v), dtype=np.int64)) for c, k, v in zip(*(part[n].to_pylist() for n in ("chunk", "keys", "low")))]
        keys, number = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, number, np.concatenate([v for _, _, v in asked]))
        bucket, at, out = part["bucket"][0].as_py(), 0, []
        for c, k, v in asked:
            out.append((c, bucket, 1, len(k), _bits(least[number[at : at + len(k)]] < v)))
            at += len(k)
        return x.table(["chunk", "bucket", "kind", "n", "bits"], out, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    source = packed.select("chunk", "main").groupBy("chunk")
    runs = source.cogroup(anchors.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk bigint, keys binary, low binary")
    answers = anchors.unionByName(runs.groupBy("bucket").applyInArrow(smaller, answer))

    def cut(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            one = Chunk(x.thaw(own["main"][0].as_py()), run, x.Words())
            _, number, _, _ = one.anchors(buckets)
            _, low, of_key, doc, place = one.candidates(take(answers, 0), number)
            before = take(answers, 1)
            ids = np.array([i if i is not None else 0 for i, _ in one.docs], dtype=np.int64)
            go = before[of_key] | (ids[doc] > low[of_key]) if len(of_key) else np.zeros(0, dtype=bool)
            doc, place = doc[go], place[go]
            first = np.searchsorted(doc, np.arange(len(one.docs) + 1))
            for d, (i, text) in enumerate(one.docs):
                words = text.split() if text else []
                own_places = place[first[d] : first[d + 1]]
                spans = []
                if len(own_places):
                    fresh = np.flatnonzero(np.concatenate([[True], np.diff(own_places) > run]))
                    spans = list(zip(own_places[fresh].tolist(), (own_places[np.append(fresh[1:], len(own_places)) - 1] + run).tolist()))
                kept = words
                for a, b in reversed(spans):
                    kept = kept[:a] + kept[b:]
                out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        return x.table(["doc_id", "n_words", "n_removed", "kept_sha256", "removed"], out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))])

    return source.cogroup(answers.groupBy("chunk")).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")
