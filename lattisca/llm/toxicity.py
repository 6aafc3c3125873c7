"""Toxicity with a linear-chain conditional random field.

Labels are per document, so the labels of tokens are latent: a clean document has no toxic token, a toxic one at least
one. They start from stems (beginnings of 3 to 8 letters that at least two more follow, or whole words) that stand in toxic
documents and not in clean ones, taken greedily until the toxic documents are covered several times. Then rounds of
expectation-maximisation take turns: forward-backward marginals, constrained to at least one toxic token in each toxic
document, label the tokens anew, and gradient steps fit the field to these labels. The field has two labels, weights for the
stems of a token and of its neighbours, for a token's shape, and a transition matrix. A text's score is a logistic
function, fitted on the same documents, of the expected number of toxic tokens; its spans are the tokens
whose marginal is at least one half.

Forward and backward passes run over all texts of a batch at once: texts are cut in segments, each segment's transfer
matrix is built by vector steps over all segments, messages pass from segment to segment, and a second sweep gives exact marginals.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattisca.llm.common import returns_memory, slices

#: Bounds of the fit: labelled documents and their UTF-8 bytes, taken by hash of doc_id; tokens of the gradient steps, half of them from toxic documents; stems that are candidates, and that are taken.
SAMPLE, SAMPLE_BYTES, TOKENS, CANDIDATES, STEMS = 8_000, 48_000_000, 400_000, 4_000, 400
#: Gradient steps before each labelling; what share of surely clean toxic documents teach nothing.
STEPS, EVIDENCE = (40, 15, 15), 0.05
THRESHOLD, SEGMENT, CACHE = 0.7, 128, 200_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Words in lower case, one for each word of the text itself: where lower case has another length, words are found first."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in range(3, min(8, len(word) - 2) + 1)] + ["=" + word]


def shape_of(word: str) -> str:
    """A word's length in steps of three, and whether it has other letters than ASCII ones."""
    return f"~{min(len(word), 12) // 3}{'' if word.isascii() else 'x'}"


class Chain:
    """Exact marginals of a two-label chain over many sequences at once. odds: log potential of label 1 against 0 of each token; a sequence starts from label 0.

    With weights (one a sequence) also pairs, the weighted expected transitions, and clean, the log probability that a sequence has no label 1.
    """

    def __init__(self, odds: np.ndarray, sizes: np.ndarray, trans: np.ndarray, segment: int = SEGMENT, weights: np.ndarray | None = None):
        pieces = np.maximum(1, -(-sizes // segment)) * (sizes > 0)
        self.doc = np.repeat(np.arange(len(sizes)), pieces)
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + self.nth * segment
        length = np.minimum(segment, np.repeat(sizes, pieces) - self.nth * segment)
        longest = int(length.max(initial=0))
        at = start[None, :] + np.arange(longest)[:, None]
        self.inside = np.arange(longest)[:, None] < length[None, :]
        self.at = at[self.inside]
        psi = np.ones(at.shape)
        psi[self.inside] = np.exp(np.clip(odds[self.at], -30, 30))
        a = np.exp(trans)
        n = len(self.doc)

        def forward(f, t):
            zero = f[..., 0] * a[0, 0] + f[..., 1] * a[1, 0]
            one = (f[..., 0] * a[0, 1] + f[..., 1] * a[1, 1]) * psi[t][:, None] if f.ndim == 3 else (f[..., 0] * a[0, 1] + f[..., 1] * a[1, 1]) * psi[t]
            return np.stack([zero, one], axis=-1)

        # Transfer matrix of each segment, rows by the label before it, scaled to sum 1.
        m = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        for t in range(longest):
            new = forward(m, t)
            new /= new.sum(axis=(1, 2), keepdims=True)
            m = np.where(self.inside[t][:, None, None], new, m)
        into, back = np.zeros((n, 2)), np.ones((n, 2))
        into[:, 0] = 1
        order = np.argsort(self.nth, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(self.nth[order])) + 1) if n else []
        for own in groups[1:]:
            v = np.einsum("ni,nij->nj", into[own - 1], m[own - 1])
            into[own] = v / v.sum(axis=1, keepdims=True)
        for own in reversed(groups[1:]):
            v = np.einsum("nij,nj->ni", m[own], back[own])
            back[own - 1] = v / v.sum(axis=1, keepdims=True)
        alpha = np.zeros((longest + 1, n, 2))
        alpha[0] = into
        for t in range(longest):
            new = forward(alpha[t], t)
            alpha[t + 1] = np.where(self.inside[t][:, None], new / new.sum(axis=1, keepdims=True), alpha[t])
        self.marginal = np.zeros(len(odds))
        beta, both = back, np.zeros(at.shape)
        self.pairs, self.clean = np.zeros((2, 2)), np.zeros(len(sizes))
        for t in range(longest - 1, -1, -1):
            joint = alpha[t + 1] * beta
            both[t] = joint[:, 1] / joint.sum(axis=1)
            ahead = np.stack([beta[:, 0], beta[:, 1] * psi[t]], axis=1)
            if weights is not None:
                own = self.inside[t]
                pair = (alpha[t][:, :, None] * a[None] * ahead[:, None, :])[own]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                self.pairs += np.einsum("n,nij->ij", weights[self.doc[own]], pair)
                self.clean += np.bincount(self.doc[own], np.log(np.maximum(pair[:, 0, 0], 1e-300) / np.maximum(pair[:, 0].sum(axis=1), 1e-300)), len(sizes))
            new = np.einsum("ij,nj->ni", a, ahead)
            beta = np.where(self.inside[t][:, None], new / new.sum(axis=1, keepdims=True), beta)
        self.marginal[self.at] = both[self.inside]


def _beside(values: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """Values of the tokens before (step 1) or after (step -1) in the same sequence, 0 at its ends."""
    out = np.zeros_like(values)
    of = np.repeat(np.arange(len(sizes)), sizes)
    same = of[1:] == of[:-1]
    if step == 1:
        out[1:][same] = values[:-1][same]
    else:
        out[:-1][same] = values[1:][same]
    return out


class Known:
    """Numbers of words, and rows of their odds: own, for the token after, for the token before."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, 3))

    def add(self, word: str, row: tuple[float, float, float]) -> None:
        n = len(self.number)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = row
        self.number[word] = n


class Model:
    """weights: of each stem, for a token that has it, the token after and the token before; shapes: of each shape."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], shapes: dict[str, float], bias: float, trans: np.ndarray, scale: tuple[float, float]):
        self.weights, self.shapes, self.bias, self.trans, self.scale = weights, shapes, bias, trans, scale

    def odds(self, word: str) -> tuple[float, float, float]:
        own, after, before = self.bias + self.shapes.get(shape_of(word), 0.0), 0.0, 0.0
        for s in stems_of(word) if self.weights else ():
            if s in self.weights:
                x = self.weights[s]
                own, after, before = own + x[0], after + x[1], before + x[2]
        return own, after, before

    def marginals(self, docs: list[list[str]], known: Known) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        number = known.number
        for d in docs:
            for w in set(d).difference(number):
                known.add(w, self.odds(w))
        at = np.fromiter((number[w] for d in docs for w in d), dtype=np.int64, count=int(sizes.sum()))
        own, after, before = known.rows[at].T
        if len(number) > CACHE:
            number.clear()
        return Chain(own + _beside(after, sizes, 1) + _beside(before, sizes, -1), sizes, self.trans).marginal, sizes

    def score(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * np.log(expected + 0.01) + self.scale[1])))


def expected_count(marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected toxic tokens of each sequence, of those whose marginal is at least 0.05: thousands of surely clean tokens must not add up."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(of, np.where(marginal >= 0.05, marginal, 0), len(sizes))


def pick_stems(docs: list[list[str]], toxic: list[int], most: int = STEMS) -> list[str]:
    """Stems by greedy cover: each pick halves the weight of the toxic documents that hold it; clean documents count against a stem."""
    bad, good, held = Counter(), Counter(), []
    for words, label in zip(docs, toxic):
        own = {s for w in set(words) for s in stems_of(w)}
        (bad if label else good).update(own)
        if label:
            held.append(own)
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    odds = {s: np.log((c + 0.5) / (n_bad + 1)) - np.log((good[s] + 0.5) / (n_good + 1)) for s, c in bad.items() if c >= 2}
    strong = sorted((s for s, o in odds.items() if o >= 2.5), key=lambda s: (-bad[s], s))[:CANDIDATES]
    if not strong:
        return []
    inside = np.array([[s in own for own in held] for s in strong], dtype=np.float32)
    against = np.array([good[s] for s in strong], dtype=np.float32)
    weight, picked = np.ones(len(held), dtype=np.float32), []
    least = max(0.7, 0.003 * len(held))
    for _ in range(most):
        gain = inside @ weight - against
        k = int(np.argmax(gain))
        if gain[k] < least:
            break
        picked.append(strong[k])
        weight[inside[k] > 0] *= 0.5
        inside[[s.lstrip("=").startswith(strong[k].lstrip("=")) for s in strong]] = 0  # what a shorter stem has, longer ones need not repeat
    return picked


def fit(texts: list[str], toxic: list[int], steps: tuple[int, ...] = STEPS) -> Model:
    """A model of labelled texts. Without a toxic or without a clean text, all scores are that label's share."""
    one: dict[str, str] = {}  # equal words are one object: the sample has few distinct ones
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    picked = pick_stems(docs, toxic)
    order = np.random.default_rng(0).permutation(len(docs)) if docs else []
    chosen = []
    for label in (1, 0):
        n = 0
        for i in order:
            if toxic[i] == label and n < TOKENS // 2:
                chosen.append(i)
                n += len(docs[i])
    share = (sum(toxic) + 0.5) / (len(toxic) + 1) if toxic else 0.0
    flat = (0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else -3.0)
    if not picked or not any(docs[i] for i in chosen):
        return Model({}, {}, -4.0, np.zeros((2, 2)), flat)
    model = _field([docs[i] for i in chosen], np.array([toxic[i] for i in chosen]), picked, steps, flat)
    if 0 < sum(toxic) < len(toxic):
        x, known = [], Known()
        for k in range(0, len(docs), 500):
            x.append(expected_count(*model.marginals(docs[k : k + 500], known)))
        x, y = np.log(np.concatenate(x) + 0.01), np.array(toxic, dtype=float)
        w, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic fit with a small penalty
            p = 1 / (1 + np.exp(-(w * x + b)))
            g = np.array([((y - p) * x).sum() - 0.5 * w, (y - p).sum() - 0.01 * b])
            v = p * (1 - p)
            h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
            w, b = (w, b) + np.linalg.solve(h, g)
        model.scale = (max(0.0, float(w)), float(b))
    return model


def _field(docs: list[list[str]], toxic: np.ndarray, picked: list[str], steps: tuple[int, ...], scale: tuple[float, float]) -> Model:
    """The field's weights by rounds of gradient steps and of labelling."""
    number = {s: k for k, s in enumerate(picked)}
    hits: dict[str, list[int]] = {}
    shapes: dict[str, int] = {}
    rows, cols, shape, sizes, at = [], [], [], np.array([len(d) for d in docs], dtype=np.int64), 0
    for d in docs:
        for w in d:
            own = hits.get(w)
            if own is None:
                own = hits[w] = [number[s] for s in stems_of(w) if s in number]
                shapes.setdefault(shape_of(w), len(shapes))
            for k in own:
                rows.append(at)
                cols.append(k)
            shape.append(shapes[shape_of(w)])
            at += 1
    rows, cols, shape = (np.array(x, dtype=np.int64) for x in (rows, cols, shape))
    of, n, p = np.repeat(np.arange(len(sizes)), sizes), at, len(picked)
    after = (rows + 1 < n) & (of[np.minimum(rows + 1, n - 1)] == of[rows])
    before = (rows > 0) & (of[np.maximum(rows - 1, 0)] == of[rows])
    own_rows = rows
    rows = np.concatenate([rows, rows[after] + 1, rows[before] - 1, np.arange(n)])
    cols = np.concatenate([cols, cols[after] + p, cols[before] + 2 * p, 3 * p + shape])
    width = 3 * p + len(shapes)
    theta = np.zeros(width + 5)
    theta[:p], theta[width] = 4, -4

    def odds():
        return theta[width] + np.bincount(rows, theta[cols], n)

    gold = np.zeros(n)
    gold[own_rows] = 1
    gold *= toxic[of] == 1
    last = np.where(np.concatenate([[True], of[1:] != of[:-1]]), 0, np.concatenate([[0], gold[:-1]])).astype(int)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (last, gold.astype(int)), 1)
    each = np.ones(len(sizes))
    for turn, count in enumerate(steps):
        if turn:
            # Marginals given that a toxic document has a toxic token; documents that show none to the field teach nothing.
            chain = Chain(odds(), sizes, theta[width + 1 :].reshape(2, 2), weights=each)
            clean = np.exp(chain.clean)
            held = (toxic == 1) & (1 - clean >= EVIDENCE)
            weight = np.where(held, 1 / np.maximum(1 - clean, EVIDENCE), 0)
            gold = np.minimum(1, chain.marginal * weight[of])
            pairs = Chain(odds(), sizes, theta[width + 1 :].reshape(2, 2), weights=weight).pairs
            pairs[0, 0] += (sizes * np.where(held, -weight * clean, 1)).sum()
        target = np.concatenate([np.bincount(cols, gold[rows], width), [gold.sum()], pairs.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, count + 1):
            chain = Chain(odds(), sizes, theta[width + 1 :].reshape(2, 2), weights=each)
            now = np.concatenate([np.bincount(cols, chain.marginal[rows], width), [chain.marginal.sum()], chain.pairs.ravel()])
            slope = (target - now) / max(1.0, gold.sum()) - 1e-4 * theta
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = {s: (float(theta[k]), float(theta[p + k]), float(theta[2 * p + k])) for s, k in number.items()}
    return Model(weights, {s: float(theta[3 * p + k]) for s, k in shapes.items()}, float(theta[width]), theta[width + 1 :].reshape(2, 2), scale)


def held_out(key: str = "doc_id", mod: int = 3, rest: int = 1) -> Column:
    """crc32 of the id as text, modulo; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod == rest


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on labelled documents that aren't held out, in order of the hash of doc_id: at most ``sample`` of them and about ``most_bytes`` of text. Only they reach the driver."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a few bytes a row and ``sample`` rows: safe to broadcast
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    sizes = texts.select("doc_id", F.octet_length("text").alias("b")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("b").alias("b")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # ``sample`` rows
    total, taken = 0, []
    for r in sizes:
        if total <= most_bytes:
            taken.append((r.doc_id, r.toxic))
            total += r.b
    if len(taken) < len(sizes):
        chosen = docs.sparkSession.createDataFrame(taken, chosen.schema)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").toArrow()
    seen, kept, toxic = set(), [], []
    for i, y, t in sorted(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), rows["text"].to_pylist())):
        if t not in seen:
            seen.add(t)
            kept.append(t)
            toxic.append(int(y))
    return fit(kept, toxic)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted and spans (character offsets of toxic tokens, start inclusive, stop exclusive).

    Every text is tagged whole, whatever its length. Null, empty and wordless texts have no toxic token and get the
    score of none. Repeated rows each get a row; an empty table gives none; other columns stay, those named like an output are replaced.
    """
    out = docs.drop("score", "predicted", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(out.schema.fields + StructType.fromDDL("score double, predicted int, spans array<struct<start:bigint,stop:bigint>>").fields)

    @returns_memory
    def tag(batches):
        m, known = held.value, Known()
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                docs = [words_of(t) if t else [] for t in texts]
                marginal, sizes = m.marginals(docs, known)
                scores = m.score(expected_count(marginal, sizes))
                ends, spans = np.cumsum(sizes), [[] for _ in texts]
                for i in np.flatnonzero(np.bincount(np.repeat(np.arange(len(sizes)), sizes), marginal >= 0.5, len(sizes))):
                    own = np.flatnonzero(marginal[ends[i] - sizes[i] : ends[i]] >= 0.5)
                    low = texts[i].lower()
                    at = [x.span() for x in WORD.finditer(low if len(low) == len(texts[i]) else texts[i])]
                    spans[i] = [{"start": at[k][0], "stop": at[k][1]} for k in own.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=[*batch.schema.names, "score", "predicted", "spans"],
                )

    return out.mapInArrow(tag, schema)
