"""SentencePiece encoding and decoding by n-best search over the piece lattice.

A forward Viterbi pass gives the best score of every prefix. Backward A* from the end then takes those scores as its
heuristic: it is exact, so segmentations leave the agenda best first and each costs one pop per piece.

No piece of a vocabulary spans certain places (a space after a letter, say), so a text falls apart in chunks that are
searched on their own and remembered; the n best of a text combine the n best of its chunks, by the same search over
the chunks whose second choices lose least. Where to cut is checked against the vocabulary, not assumed.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lattisca.llm.common import returns_memory, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N = 3
#: Chunks that a task remembers; what an unknown character scores below the worst piece.
CACHE, UNKNOWN = 600_000, 10.0

SPACE = "▁"
_LETTER = "A-Za-zÀ-ɏ"
#: Ways to cut a text, finest first, each with the pattern of pieces that forbid it.
_CUTS = (
    (rf" *[{_LETTER}]+|\n| *[^{_LETTER} \n]+| +", rf"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{SPACE}][{_LETTER}]|[^{SPACE}]{SPACE}|.\n|\n."),
    (r" *[^ \n]+|\n| +", rf"[^{SPACE}]{SPACE}|.\n|\n."),
    (r"(?s:.+)", r"(?!)"),
)


def n_best(size: int, edges: list[list[tuple[int, float, int]]], n: int) -> list[tuple[float, list[int]]]:
    """The n best paths from 0 to size, as (score, labels), best first. edges[j]: (i, score, label) of the edges into j, i < j."""
    best = [0.0] + [-np.inf] * size
    for j in range(1, size + 1):
        for i, score, _ in edges[j]:
            if best[i] + score > best[j]:
                best[j] = best[i] + score
    out: list[tuple[float, list[int]]] = []
    agenda, count = [(-best[size], 0, size, 0.0, None)], 1
    while agenda and len(out) < n:
        f, _, j, done, tail = heapq.heappop(agenda)
        if j == 0:
            labels = []
            while tail:
                labels.append(tail[0])
                tail = tail[1]
            out.append((-f, labels))
            continue
        for i, score, label in edges[j]:
            if best[i] > -np.inf:
                heapq.heappush(agenda, (-(best[i] + done + score), count, i, done + score, (label, tail)))
                count += 1
    return out


_IDS, _SCORE, _GAP = itemgetter(0), itemgetter(1), itemgetter(2)


def _unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype=np.int32).tolist()


class Chunks(dict):
    """The best segmentation of each chunk, as (ids packed as 32-bit integers, score, what the second best loses), and the n best of those asked for, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.ways = vocabulary, {}

    def __missing__(self, chunk: str) -> tuple[bytes, float, float]:
        if len(self) > CACHE:
            self.clear()
        ids, score, gap = self.vocabulary.two_best(chunk)
        self[chunk] = found = array("i", ids).tobytes(), score, gap
        return found

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        found = self.ways.get((chunk, n))
        if found is None:
            if len(self.ways) > CACHE // 20:
                self.ways.clear()
            self.ways[chunk, n] = found = self.vocabulary.segment(chunk, n)
        return found


class Vocabulary:
    """Pieces with scores. A character that no piece has is one unknown edge, which stands for its UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int], byte_ids: list[int]):
        self.piece = dict(zip((p for p, _ in pieces), zip(ids, (s for _, s in pieces))))
        self.trie: list = [{}, None, None]  # nodes by character, then score and id of the piece that ends here, if one does
        for p, (i, score) in self.piece.items():
            at = self.trie
            for c in p:
                at = at[0].setdefault(c, [{}, None, None])
            at[1:] = score, i
        self.unknown = min((s for _, s in pieces if s > -1e8), default=0.0) - UNKNOWN
        self.byte_ids = byte_ids
        self.text = {i: p.replace(SPACE, " ") for (p, _), i in zip(pieces, ids)}
        self.whole = self.text | {i: chr(b) for b, i in enumerate(byte_ids[:128])}  # ids that are text on their own: pieces, and bytes of ASCII
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.cut = next(re.compile(c) for c, forbid in _CUTS if not any(re.search(forbid, p, re.S) for p, _ in pieces))

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in plain], plain, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def lattice(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """Edges into each place of chunk; an unknown character's edge is labelled with its code point, negated and less one."""
        mapped = chunk.replace(SPACE, "\0").replace(" ", SPACE)
        n, edges = len(mapped), [[] for _ in range(len(mapped) + 1)]
        for i in range(n):
            at = self.trie
            for j in range(i, n):
                at = at[0].get(mapped[j])
                if at is None:
                    break
                if at[1] is not None:
                    edges[j + 1].append((i, at[1], at[2]))
            if not edges[i + 1] or edges[i + 1][-1][0] != i:
                edges[i + 1].append((i, self.unknown, -ord(chunk[i]) - 1))
        return edges

    def two_best(self, chunk: str) -> tuple[list[int], float, float]:
        """Ids and score of the best segmentation, and how much less the second best scores (infinity if there is none): one forward pass that keeps two scores a place."""
        mapped = chunk.replace(SPACE, "\0").replace(" ", SPACE)
        n, first, unknown, none = len(mapped), self.trie[0], self.unknown, ({}, None, None)
        best, back = [-np.inf] * (n + 1), [None] * (n + 1)
        second = best[:]
        best[0] = 0.0
        chars = [*mapped, None]  # no piece goes on with None
        for i in range(n):
            b, b2, k = best[i], second[i], i + 1
            more, score, label = first.get(chars[i], none)
            if score is None:
                score, label = unknown, -ord(chunk[i]) - 1
            while True:
                if score is not None:
                    s, was = b + score, best[k]
                    if s > was:
                        s2 = b2 + score
                        second[k] = s2 if s2 > was else was
                        best[k], back[k] = s, (i, label)
                    elif s > second[k]:
                        second[k] = s
                if not more:
                    break
                node = more.get(chars[k])
                if node is None:
                    break
                more, score, label = node
                k += 1
        labels, j = [], n
        while j:
            j, label = back[j]
            labels.append(label)
        labels.reverse()
        return (labels if min(labels) >= 0 else self.ids(labels)), best[n], best[n] - second[n]

    def ids(self, labels: list[int]) -> list[int]:
        return [k for x in labels for k in ([x] if x >= 0 else [self.byte_ids[b] for b in chr(-x - 1).encode("utf-8", "surrogatepass")])]

    def segment(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        return [(s, self.ids(x)) for s, x in n_best(len(chunk), self.lattice(chunk), n)]

    def _search(self, text: str, n: int, cache: Chunks):
        """Chunk results of a text, its best score, and the n best as (score lost, ids by chunk number)."""
        chunks = self.cut.findall(" " + text)
        parts = list(map(cache.__getitem__, chunks))
        ways = [(0.0, {})]
        if n > 1:
            # Only the n - 1 chunks whose second choice loses least can differ from the best in the n best.
            gaps = np.fromiter(map(_GAP, parts), dtype=float, count=len(parts))
            loose = np.argpartition(gaps, n - 2)[: n - 1].tolist() if len(gaps) >= n else list(range(len(gaps)))
            loose = sorted(at for at in loose if gaps[at] < np.inf)
            others = [cache.n_best(chunks[at], n) for at in loose]
            edges = [[], *[[(k, s - own[0][0], v) for v, (s, _) in enumerate(own)] for k, own in enumerate(others)]]
            ways += [(lost, {at: own[v][1] for at, own, v in zip(loose, others, choice)}) for lost, choice in n_best(len(loose), edges, n)[1:]]
        return parts, sum(map(_SCORE, parts)), ways

    def encode(self, text: str | None, n: int = N, cache: Chunks | None = None) -> list[tuple[float, list[int]]]:
        """The n best segmentations as (score, ids), best first; one empty segmentation of a null or empty text."""
        if not text:
            return [(0.0, [])]
        parts, total, ways = self._search(text, n, Chunks(self) if cache is None else cache)
        return [(total + lost, [k for i, own in enumerate(parts) for k in at.get(i) or _unpacked(own[0])]) for lost, at in ways]

    def ranked(self, text: str, n: int, cache: Chunks) -> tuple[list[float], list[int], list[list[tuple[int, int, list[int]]]]]:
        """Scores of the n best segmentations, the ids of the best, and of each other one its edits of these: (start, stop, ids in their place), in order."""
        scores, ids, edits = self.packed(text, n, cache)
        return scores, _unpacked(ids), edits

    def packed(self, text: str, n: int, cache: Chunks) -> tuple[list[float], bytes, list[list[tuple[int, int, list[int]]]]]:
        """As ranked(), with the ids of the best packed as 32-bit integers."""
        if not text:
            return [0.0], b"", []
        parts, total, ways = self._search(text, n, cache)
        places, before, done = {}, 0, 0
        for at in sorted({at for _, own in ways for at in own}):
            before += sum(map(len, map(_IDS, parts[done:at]))) // 4
            places[at], done = before, at
        first = {at: _unpacked(parts[at][0]) for at in places}
        edits = [[(places[at], places[at] + len(first[at]), ids) for at, ids in sorted(own.items()) if ids != first[at]] for _, own in ways[1:]]
        return [total + lost for lost, _ in ways], b"".join(map(_IDS, parts)), edits

    def decode(self, ids: list[int]) -> str:
        """The text of ids, exactly as it was encoded."""
        if not ids:
            return ""
        text, byte_of = self.text, self.byte_of
        try:
            return "".join(map(self.whole.__getitem__, ids))[1:]
        except KeyError:
            raw = b"".join(bytes([byte_of[i]]) if i in byte_of else text[i].encode() for i in ids)
            return raw.decode("utf-8", "surrogatepass")[1:]


def edited(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another segmentation: edits of ranked(), made from the last to the first."""
    out = list(ids)
    for start, stop, new in reversed(edits):
        out[start:stop] = new
    return out


def encode_table(docs: DataFrame, path: str = MODEL, n: int = N) -> DataFrame:
    """docs with n_tokens, ids (the best segmentation), ids_sha256 (of the ids as 32-bit little-endian integers), scores (of the n best, best first), others (of the second best to the n-th the edits that make its ids of the best's, see edited()) and decoded (ids read back).

    Scores are sums of the vocabulary's piece scores. Those of the default vocabulary, made by merges, are ranks of merges and no log probabilities;
    a unigram vocabulary's are.

    The vocabulary is read on the driver and broadcast: it has a fixed number of pieces. Texts are encoded whole. A null
    text has null ids, digest, scores, others and decoded and 0 tokens; an empty one has none of length 0. Texts with one segmentation
    have one score and no others. Ties between segmentations go to any, always the same. Repeated rows each get a row, an empty table
    none; other columns stay, those named like an output are replaced.
    """
    names = ["n_tokens", "ids", "ids_sha256", "scores", "others", "decoded"]
    out = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    schema = StructType(out.schema.fields + StructType.fromDDL("n_tokens bigint, ids array<int>, ids_sha256 string, scores array<double>, others array<array<struct<start:int,stop:int,ids:array<int>>>>, decoded string").fields)

    others_type = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    @returns_memory
    def encoded(batches):
        v = held.value
        cache = Chunks(v)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                scores, ids, others = zip(*[(None, None, None) if t is None else v.packed(t, n, cache) for t in texts])
                packed = [None if i is None else np.frombuffer(i, dtype=np.int32).astype("<i4", copy=False) for i in ids]
                sizes = np.array([0 if i is None else len(i) for i in packed], dtype=np.int64)
                flat = np.concatenate([np.zeros(0, dtype="<i4"), *[i for i in packed if i is not None]])
                digests = [None if i is None else hashlib.sha256(i.tobytes()).hexdigest() for i in packed]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pa.array([i is None for i in ids]))
                back = [None if i is None else v.decode(i.tolist()) for i in packed]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), lists, pa.array(digests, pa.string()), pa.array(scores, pa.list_(pa.float64())), pa.array([None if o is None else [[dict(zip(("start", "stop", "ids"), e)) for e in way] for way in o] for o in others], others_type), pa.array(back, pa.string())], names=[*batch.schema.names, *names])

    return out.mapInArrow(encoded, schema)

