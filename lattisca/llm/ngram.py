"""Language-model scores by deleted interpolation of trigrams, bigrams and single tokens.

p2(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), and p(w | u, v) = l3 c(u, v, w) / c(u, v) + (1 - l3) p2(w | v). The weights
of each order depend on the bucket of its context's count, the power of two that c(v) or c(u, v) reaches. Counts are
gathered from all training texts. One in seven of the texts is held out of them while the weights
are learned: expectation-maximisation on its tokens against the counts of the rest, first for p2, then for p given p2. The model then uses all
training counts with those weights.

N-gram counts never meet token rows: chunks of documents send their distinct keys and counts to hash buckets and get
the totals back in the order they sent them (exchange.py). For the weights, held-out tokens are summed in cells of
(bucket, quantised ratio of each mixed share to the uniform one): a table of bounded size for each order, on which the driver runs EM.
A cell's ratios are off by a factor of 2 to the power of 1/16 (4.4 %) at most; this touches the weights alone, scores take exact counts. Single tokens are told apart by 64 bits of hash, n-grams by 56: of 10^10
different n-grams one in seven million shares its count with another, of 10^13 one in 7,000.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm import exchange as x
from lattisca.llm.common import each_returns_memory, returns_memory, spool

#: Of the crc32 of the id, modulo 7: texts that are scored unseen, and training texts held out for the weights.
MOD, UNSEEN, DELETED = 7, 2, 6
#: Buckets of context counts (0, 1, 2-3, 4-7, ...), steps of a doubling in a cell, the step of ratio 1, rounds of EM.
LEVELS, STEPS, EVEN, ROUNDS = 24, 8, 1000, 60
#: Bits of the hash by which bigrams and trigrams are told apart: the upper 56. Steps between those kept cost a byte less to send.
_WIDE = np.uint64(2**64 - 2**8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BEGIN, _END = np.uint64(0x5EED0000BEEF0001), np.uint64(0x5EED0000BEEF0002)


def part_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 7; a null id counts as ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MOD


def level(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm, LEVELS - 1 at most."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0), LEVELS - 1)


def _hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word. It costs less than looking the word up among those seen, and holds nothing."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)


class Tokens:
    """Keys of the tokens of documents: words, then one end, each with what stands before it."""

    def __init__(self, docs: x.Docs):
        own, self.sizes = [np.zeros(0, dtype=np.uint64)], []
        for _, text in docs:
            words = text.translate(_LOWER).split() if text else []
            own.append(np.append(_hashed(words), _END))
            self.sizes.append(len(words) + 1)
        self.words = np.concatenate(own)
        self.sizes = np.array(self.sizes, dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([[_BEGIN], self.words[:-1]]) if len(self.words) else self.words
        self.before[self.first] = _BEGIN
        self.pairs = x.mix(self.before, self.words) & _WIDE
        self.later = np.ones(len(self.words), dtype=bool)  # tokens with two before them, the beginning counted as one
        self.later[self.first] = False
        self.triples = x.mix(self.pairs[:-1], self.words[1:])[self.later[1:]] & _WIDE

    def singles(self) -> np.ndarray:
        """Each word token, and the beginning once a document: contexts are counted among them."""
        return np.concatenate([self.words, np.full(len(self.sizes), _BEGIN)])


def _total(keys: np.ndarray, weights: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.bincount(number, weights, len(keys)).astype(np.int64)


def fit_weights(cells: np.ndarray, start: list[float], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of each level by EM, the first of them that of the highest order, which is 0 at level 0.

    cells: rows of level, steps of the ratio of each mixed share to the uniform one (-1: zero), tokens. start: the first weights, and counts as one token.
    """
    out = np.tile(np.array(start), (LEVELS, 1))
    for k in range(LEVELS):
        own = cells[cells[:, 0] == k]
        ratio = np.where(own[:, 1:-1] >= 0, 2.0 ** ((own[:, 1:-1] - EVEN) / STEPS), 0)
        lam = out[k]
        for _ in range(rounds):
            share = ratio * lam
            share /= share.sum(axis=1, keepdims=True)
            lam = (own[:, -1] @ share if len(own) else np.zeros(len(start))) + np.array(start)
            lam = np.maximum(lam / lam.sum(), 1e-6)
            lam /= lam.sum()
        out[k] = lam
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def _cell(share: np.ndarray, uniform: float) -> np.ndarray:
    return np.where(share > 0, np.rint(np.log2(np.maximum(share, 1e-300) / uniform) * STEPS) + EVEN, -1).astype(np.int64)


def score_texts(docs: DataFrame, chunk: int = x.CHUNK, bucket: int = x.BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row.

    Tokens are runs of anything but ASCII white space, A-Z in lower case, then one end. Null, empty and blank texts
    have the end alone. A null doc_id counts as '' and so trains. Repeated rows count and score as often as they come; without a
    training text all counts are zero and every token has probability 1. An empty table gives no rows; other columns aren't read.
    """
    packed = x.chunks(docs, apart=lambda i: part_of(i) == DELETED, size=chunk, level=6)
    buckets = x.buckets_for(packed, bucket)

    def sent(main: x.Docs, other: x.Docs) -> list[list[bytes]]:
        """Keys and counts of a chunk, packed for each bucket; none for buckets without a key. One order after another, so that one is held unpacked."""
        a, b = Tokens(main), Tokens(other)
        trains = np.array([part_of(i) != UNSEEN for i, _ in main], dtype=float)
        weight = np.repeat(trains, a.sizes)
        out, some = [[] for _ in range(buckets)], np.zeros(buckets, dtype=bool)
        for keys, weights, others in (
            (lambda: (a.singles(), b.singles()), lambda: np.concatenate([weight, trains]), len(b.words) + len(b.sizes)),
            (lambda: (a.pairs, b.pairs), lambda: weight, len(b.pairs)),
            (lambda: (a.triples, b.triples), lambda: weight[a.later], len(b.triples)),
        ):
            distinct, at = np.unique(np.concatenate(keys()), return_inverse=True)
            kept = _total(distinct, weights(), at[: len(at) - others])
            gone = np.bincount(at[len(at) - others :], minlength=len(distinct))
            del at
            cut = x.edges(distinct, buckets)
            some |= cut[1:] > cut[:-1]
            for k in range(buckets):
                s = slice(cut[k], cut[k + 1])
                out[k] += [x.pack_sorted(distinct[s]), x.pack(kept[s]), x.pack(gone[s])]
        return [own if there else [] for own, there in zip(out, some)]

    @returns_memory
    def ask(batches):
        def asked_of():
            for batch in batches:
                for number, main, other in zip(batch.column("chunk").to_pylist(), batch.column("main"), batch.column("other")):
                    for k, own in enumerate(sent(x.thaw(main.as_py()), x.thaw(other.as_py()))):
                        if own:
                            yield k, number, *own

        yield from x.rows(["bucket", "chunk", *names], asked_of(), [pa.int32(), pa.int64(), *[pa.binary()] * 9])

    names = [c + n for n in "123" for c in ("keys", "kept", "gone")]

    def ints(data: bytes) -> np.ndarray:
        return x.unpack(data).view(np.int64)

    def summed(part: pa.Table, n: str) -> tuple[list[list[bytes]], tuple[int, int, int]]:
        """For each chunk the packed totals of its keys of an order; of single tokens also how many there are, how many differ, and how many are kept."""
        keys = [x.unpack_sorted(k.as_py()) for k in part["keys" + n]]
        ends, keys = np.cumsum([0, *map(len, keys)]), np.concatenate(keys)
        distinct, at = np.unique(keys, return_inverse=True)
        del keys
        kept_all = _total(distinct, np.concatenate([ints(v.as_py()) for v in part["kept" + n]]), at)
        gone = np.concatenate([ints(v.as_py()) for v in part["gone" + n]])
        both, there = kept_all + _total(distinct, gone, at), gone > 0
        del gone
        real = distinct != _BEGIN
        counted = int(both[real].sum()), int((both[real] > 0).sum()), int(kept_all[real].sum())
        del distinct
        return [[x.pack(both[at[i:j]]), x.pack(kept_all[at[i:j][there[i:j]]])] for i, j in zip(ends[:-1], ends[1:])], counted

    @each_returns_memory
    def add(part: pa.Table) -> pa.Table:
        bucket = part["bucket"][0].as_py()
        answers = [[c, bucket, 0, 0, 0] for c in part["chunk"].to_pylist()]
        total = [-1, bucket]
        for n in "123":
            found, counted = summed(part, n)
            total += counted if n == "1" else []
            for answer, own in zip(answers, found):
                answer += own
        return x.table(list(answer_columns), [tuple(a) for a in [*answers, [*total, *[b""] * 6]]], [pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6])

    answer_columns = {"chunk": "bigint", "bucket": "int", "tokens": "bigint", "types": "bigint", "tokens_kept": "bigint"} | {c + n: "binary" for n in "123" for c in ("all", "kept")}
    asked = packed.mapInArrow(ask, "bucket int, chunk bigint, " + ", ".join(f"{n} binary" for n in names))
    answers = spool(asked.groupBy("bucket").applyInArrow(add, ", ".join(f"{c} {t}" for c, t in answer_columns.items())), "counts")
    totals = answers.filter("chunk = -1").agg(F.sum("tokens"), F.sum("types"), F.sum("tokens_kept")).first()  # one row a bucket
    n_all, v_all, n_kept = (int(n or 0) for n in totals)
    uniform = 1.0 / (v_all + 1)

    def counts(part: pa.Table, column: str) -> np.ndarray:
        got = sorted(zip(part["bucket"].to_pylist(), part[column].to_pylist()))
        return np.concatenate([np.zeros(0, dtype=np.int64), *[ints(v) for _, v in got]])

    def looked_up(t: Tokens, got: pa.Table, kind: str) -> list[np.ndarray]:
        """Counts of each token's triple, of the pair before it, of its pair, of the token before it, and of the token."""

        def of(keys: np.ndarray, n: str) -> np.ndarray:
            return counts(got, kind + n)[np.unique(keys, return_inverse=True)[1]]

        def before(count: np.ndarray, first: int) -> np.ndarray:
            out = np.concatenate([[0], count[:-1]])
            out[t.first] = first
            return out

        singles = of(t.singles(), "1")
        single, pair, triple = singles[: len(t.words)], of(t.pairs, "2"), np.zeros(len(t.words), dtype=np.int64)
        triple[t.later] = of(t.triples, "3")
        return [triple, before(pair, 0), pair, before(single, singles[-1]), single]

    def shares(count: list[np.ndarray], n: int) -> list[np.ndarray]:
        """The maximum-likelihood estimates by trigrams, bigrams and single tokens."""
        triple, two_before, pair, before, single = count
        return [np.where(c > 0, k / np.maximum(c, 1), 0) for k, c in ((triple, two_before), (pair, before))] + [single / max(n, 1)]

    def mixed(two: np.ndarray, one: np.ndarray, lam: np.ndarray) -> np.ndarray:
        return lam[:, 0] * two + lam[:, 1] * one + lam[:, 2] * uniform

    def held(lower: np.ndarray | None):
        """Cells of the held-out tokens: of bigrams, or of trigrams given the weights of bigrams."""

        def cells_of(own: pa.Table, got: pa.Table) -> pa.Table:
            cells = np.zeros((0, 5), dtype=np.int64)
            if own.num_rows and (docs_ := x.thaw(own["other"][0].as_py())):
                count = looked_up(Tokens(docs_), got, "kept")
                three, two, one = shares(count, n_kept)
                even = np.full(len(one), EVEN)
                if lower is None:
                    cell = [level(count[3]), _cell(two, uniform), _cell(one, uniform), even]
                else:
                    cell = [level(count[1]), _cell(three, uniform), _cell(mixed(two, one, lower[level(count[3])]), uniform), even]
                distinct, n = np.unique(np.stack(cell, axis=1), axis=0, return_counts=True)
                cells = np.column_stack([distinct, n])
            return pa.table({c: pa.array(cells[:, k]) for k, c in enumerate(("level", "high", "low", "even", "n"))})

        return each_returns_memory(cells_of)

    def learned(lower: np.ndarray | None, columns: list[str], start: list[float]) -> np.ndarray:
        source = packed.select("chunk", "other").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "kept1", "kept2", "kept3").filter("chunk >= 0").groupBy("chunk"))
        grid = source.applyInArrow(held(lower), "level bigint, high bigint, low bigint, even bigint, n bigint").groupBy(*columns).agg(F.sum("n")).collect()  # cells, not tokens
        return fit_weights(np.array([tuple(r) for r in grid], dtype=float).reshape(-1, len(columns) + 1), start)

    lower = learned(None, ["level", "high", "low", "even"], [0.4, 0.5, 0.1])
    upper = learned(lower, ["level", "high", "low"], [0.4, 0.6])

    @each_returns_memory
    def scored(own: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            main, other = x.thaw(own["main"][0].as_py()), x.thaw(own["other"][0].as_py())
            both = main + other
            t = Tokens(both)
            count = looked_up(t, got, "all")
            three, two, one = shares(count, n_all)
            single, lam = count[4], upper[level(count[1])]
            p = lam[:, 0] * three + lam[:, 1] * mixed(two, one, lower[level(count[3])]) if n_all else np.ones(len(single))
            of = np.repeat(np.arange(len(both)), t.sizes)
            score = np.bincount(of, np.log10(p), len(both))
            base = np.bincount(of, np.log10((single + 1) / (n_all + v_all + 1)), len(both))
            seen = np.bincount(of, single > 0, len(both)).astype(np.int64)
            out = [(i, part_of(i) == UNSEEN, int(t.sizes[k]), int(seen[k]), n_all, float(base[k]), float(score[k])) for k, (i, _) in enumerate(both)]
        return x.table(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], out, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])

    every = packed.select("chunk", "main", "other").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "all1", "all2", "all3").filter("chunk >= 0").groupBy("chunk"))
    return every.applyInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
