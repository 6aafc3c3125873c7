"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector of length n, divided by its length, padded with zeros and rotated by a fixed random orthogonal matrix, is stored as the signs of
its components (more dimensions than the vector has make the code longer and the bound tighter), packed in 64-bit words, with two scalars: its length and a, the inner product of the rotated vector
with its own code. For a query, rotated alike and quantised to a few bit planes, b = <code, query> comes from ands and bit counts;
the inner product is close to n |q| b / a. The rest of the code is orthogonal to the vector and falls on the query like a
random direction, at most sqrt(1 - a^2) long, which bounds the error: the best estimates are scored exactly first, then all vectors whose upper bound
reaches the k-th best score so far.

Queries go in blocks of bounded size, each broadcast once and searched by every task against the rows of its partition,
so memory doesn't depend on the number of rows or queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattisca.llm.common import spool

K = 20
#: Queries of a broadcast block; rows that a task codes at once; standard deviations that the error bound spans; bit planes of a query; bits of a code, at least.
BLOCK, ROWS, SPREAD, PLANES, BITS = 8192, 65536, 4.5, 5, 256
SEED = 20


def rotation(d: int, seed: int = SEED, bits: int = BITS) -> np.ndarray:
    """The first d rows of a random orthogonal matrix: it pads and rotates at once."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(d, bits), max(d, bits))))
    return (q * np.sign(np.diag(r)))[:d]


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-raw.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


class Codes:
    """One-bit codes of vectors (rows of float64)."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.norm = np.linalg.norm(x, axis=1)
        y = (x / self.norm[:, None]) @ turn
        self.words = np.ascontiguousarray(pack(y > 0).T)
        self.ones = sum(np.bitwise_count(w).astype(np.int32) for w in self.words)
        self.a = np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])
        self.rest = np.sqrt(np.maximum(0, 1 - self.a**2))


class Asked:
    """Queries, rotated and cut into bit planes."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        self.norm, d = np.linalg.norm(q, axis=1), turn.shape[1]
        y = (q / self.norm[:, None]) @ turn
        self.low = y.min(axis=1)
        self.step = np.maximum(y.max(axis=1) - self.low, 1e-12) / (2**planes - 1)
        cut = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + cut * self.step[:, None]
        self.off, self.sum, self.d = np.linalg.norm(y - near, axis=1), near.sum(axis=1), d
        self.planes = [pack((cut >> p) & 1) for p in range(planes)]

    def bounds(self, codes: Codes, i: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimate and error bound of the inner product of query i with each coded vector."""
        count = np.zeros(len(codes.a), dtype=np.int32)
        for p, plane in enumerate(self.planes):
            for word, mask in zip(codes.words, plane[i]):
                count += np.bitwise_count(word & mask).astype(np.int32) << p
        root = np.sqrt(self.d)
        b = count * (2 * self.step[i] / root) + codes.ones * (2 * self.low[i] / root) - self.sum[i] / root
        scale = codes.norm * self.norm[i] / codes.a
        return b * scale, (codes.rest * (spread / np.sqrt(max(1, self.d - 1))) + self.off[i] + 1e-9) * scale


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in order, so equal vectors score equal."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, turn: np.ndarray, best: dict, k: int = K, spread: float = SPREAD) -> None:
    """Merges the k nearest of rows ids, x of each query into best: query number -> (scores, ids), falling scores, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # Of equal vectors only the k + 1 smallest ids can be among k nearest, the query's own left out.
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) != 0]))
    nth = np.arange(len(by)) - np.repeat(fresh, np.diff(np.append(fresh, len(by))))
    kept = np.sort(by[nth <= k])
    ids, x = ids[kept], x[kept]
    codes, asked = Codes(x, turn), Asked(q, turn)
    for i in range(len(q)):
        near, error = asked.bounds(codes, i, spread)
        near[ids == q_ids[i]] = -np.inf
        old = best.get(i)
        first = np.argpartition(near, -2 * k)[-2 * k :] if len(near) > 2 * k else np.arange(len(near))
        known = (x[first] @ q[i])[near[first] > -np.inf]
        if old is not None:
            known = np.concatenate([known, old[0]])
        floor = np.sort(known)[-k] - 1e-9 * (1 + np.abs(known).max()) if len(known) >= k else -np.inf
        at = np.flatnonzero((near + error >= floor) & (near > -np.inf))
        if len(at) > k:  # a fast product first; those that may be among the k best are summed in order
            rough = x[at] @ q[i]
            at = at[rough >= np.sort(rough)[-k] - 1e-9 * (1 + np.abs(rough).max())]
        scores, own = products(np.broadcast_to(q[i], (len(at), q.shape[1])), x[at]), ids[at]
        if old is not None:
            scores, own = np.concatenate([old[0], scores]), np.concatenate([old[1], own])
        top = np.lexsort((own, -scores))[:k]
        best[i] = scores[top], own[top]


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector that isn't null, empty or zero and holds only finite numbers."""
    v = F.col("embedding")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda e: e != 0))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, spread: float = SPREAD) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (double): the k nearest of rows for each of queries, both (vec_id, embedding).

    Nearest: largest inner product in double precision, ties to the smaller vec_id; rows with the query's own id are no
    candidates, and fewer candidates give fewer rows. Only vectors of the query's length are compared. Rows that usable()
    leaves out take no part; repeated query rows count once, repeated candidate rows each. Other columns aren't read.
    With no queries or rows the result is empty.

    Queries go in blocks of about ``block``, one after another: each is read to the driver, sent out, answered by a pass over the
    rows and, where there are several, written to the shared folder before the next, so only one is held at a time.
    """
    spark = rows.sparkSession
    rows, queries = usable(rows), usable(queries)
    n = max(1, -(-queries.count() // block))
    parts = []
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    for part in range(n):
        asked = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == part).toArrow()  # a block of about ``block`` rows
        by_length: dict[int, tuple[list, list]] = {}
        for i, v in sorted({(i, tuple(v)) for i, v in zip(asked["vec_id"].to_pylist(), asked["embedding"].to_pylist())}):
            ids, vectors = by_length.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
        held = spark.sparkContext.broadcast({d: (np.array(i, dtype=np.int64), np.array(v, dtype=np.float64)) for d, (i, v) in by_length.items()})

        def found(batches, held=held):
            best: dict[int, dict] = {d: {} for d in held.value}
            turns = {d: rotation(d) for d in held.value}
            waiting: dict[int, list] = {d: [] for d in held.value}

            def flush(d):
                if waiting[d]:
                    ids, x = (np.concatenate(c) for c in zip(*waiting[d]))
                    search(ids, x, *held.value[d], turns[d], best[d], k, spread)
                    waiting[d] = []

            for batch in batches:
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                vectors = batch.column("embedding")
                lengths = np.diff(vectors.offsets.to_numpy())
                flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
                for d in held.value:
                    own = np.flatnonzero(lengths == d)
                    if len(own):
                        waiting[d].append((ids[own], flat[starts[own][:, None] + np.arange(d)]))
                        if sum(len(i) for i, _ in waiting[d]) >= ROWS:
                            flush(d)
            for d, (q_ids, _) in held.value.items():
                flush(d)
                for i, (scores, own) in sorted(best[d].items()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q_ids[i])), pa.array(own), pa.array(scores)], schema=schema)

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        own = rows.mapInArrow(found, "query_id bigint, vec_id bigint, score double").withColumn("rank", rank).filter(F.col("rank") <= k)
        own = own.select("query_id", "rank", "vec_id", "score")
        if n > 1:
            own = spool(own, "nearest")
            held.destroy()
        parts.append(own)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_table(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """nearest() with the rows whose vec_id is divisible by ``every`` as queries, against all rows."""
    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), k)
