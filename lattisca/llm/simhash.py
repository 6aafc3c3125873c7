"""SimHash near-dedup by tiled exact comparison.

Every distinct fingerprint falls in a tile by the population counts of its bit fields. Two fingerprints that differ in at
most r bits have counts that differ by at most r in sum, so tile pairs beyond the radius are skipped, whole; the rows of
the others are compared exactly, all against all, with numpy exclusive-or and bit counts. A tile of many fingerprints is
cut in pieces of bounded size, and each compared pair of pieces returns a spanning forest of its links, never all pairs,
which keeps every connection. Documents then take the smallest doc_id of their connected component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm.common import fresh, returns_memory, spool
from lattisca.llm.components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: For whole texts: the similarity that links them.
SIMILAR = 0.8
#: Texts that agree in all min-hashes of a band are compared: at a similarity of 0.8 a pair misses all bands once in eight million. Members of a bucket that one task compares with as many others.
BANDS, HASHES, MEMBERS = 40, 5, 512
#: Bits of each field whose population count is part of a tile's key; fingerprints of one piece of a tile.
FIELDS, PIECE = (11, 11, 11, 11, 10, 10), 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * HASHES, 1), dtype=np.uint32)
_ODD |= np.uint32(1)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the XXH64 hashes of the text's shingles; 0 without words."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    ends = (starts + sizes)[width - 1 :].tolist()
    starts = starts[:n].tolist()
    for k in range(0, n, 65536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], dtype=np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """A 64-bit digest of each shingle of ``width`` words in order, a shorter text being one; none without words."""
    words = text.translate(_LOWER).split() if text else []
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    wide, n = min(width, len(words)), max(1, len(words) - width + 1) if words else 0
    mixed = np.full(n, wide, dtype=np.uint64)
    for k in range(wide):
        mixed = (mixed ^ own[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def band_keys(digests: np.ndarray) -> np.ndarray:
    """A key of each band of min-hashes of a text's shingle digests; no keys for no shingles."""
    if not len(digests):
        return np.zeros(0, dtype=np.int64)
    short, low = (digests >> np.uint64(32)).astype(np.uint32), np.full(len(_XOR), 2**32 - 1, dtype=np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(low, ((short[k : k + 512] ^ _XOR) * _ODD).min(axis=1), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, HASHES).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE, banded: bool = False) -> DataFrame:
    """doc_id, hash (of the text) and fp (the fingerprint's 64 bits as a signed bigint) of each row; if banded, also keys (of its bands)."""

    @returns_memory
    def hashed(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            columns = {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "fp": pa.array(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))}
            if banded:
                columns["keys"] = pa.array([band_keys(shingles(t)) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(hashed, "doc_id bigint, hash bigint, fp bigint" + ", keys array<bigint>" * banded)


def _tile_key(fields=FIELDS):
    """A tile's number: the population counts of the fields, as digits to base 16."""
    key, at = F.lit(0).cast("bigint"), 0
    for k, bits in enumerate(fields):
        key = key + (F.bit_count(F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << bits) - 1)).cast("bigint") * (16**k))
        at += bits
    return key


def _steps(fields=FIELDS, radius: int = RADIUS) -> list[int]:
    """Differences of tile numbers within the radius, each pair of tiles in one direction."""
    found = {(0,) * len(fields)}
    for _ in range(radius):
        found |= {s[:k] + (s[k] + d,) + s[k + 1 :] for s in found for k in range(len(s)) for d in (1, -1)}
    return sorted(sum(d * 16**k for k, d in enumerate(s)) for s in found if s >= (0,) * len(fields))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between two sets of fingerprints, or inside one, thinned to a spanning forest."""
    names = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    root, us, vs = np.arange(len(names)), [], []
    for a in range(0, len(left), block):
        for b in range(a if right is None else 0, len(other), block):
            i, j = np.nonzero(np.bitwise_count(left[a : a + block, None] ^ other[None, b : b + block]) <= radius)
            i, j = i + a, j + b + shift
            while True:
                high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
                apart = np.flatnonzero(high != low)
                if not len(apart):
                    break
                # Every root but the smallest of its links hangs itself on a smaller one, by one link.
                i, j, high, low = i[apart], j[apart], high[apart], low[apart]
                own, first = np.unique(high, return_index=True)
                us.append(i[first])
                vs.append(j[first])
                parent = np.arange(len(names))
                parent[own] = low[first]
                while (up := parent[parent]).tolist() != parent.tolist():
                    parent = up
                root = parent[root]
    at = np.concatenate([np.zeros(0, dtype=np.int64), *us]), np.concatenate([np.zeros(0, dtype=np.int64), *vs])
    return names[at[0]], names[at[1]]


def links(fps: DataFrame, radius: int = RADIUS, fields=FIELDS, piece: int = PIECE) -> DataFrame:
    """(u, v): a spanning forest, per pair of tile pieces, of the links between distinct fingerprints (fp) within the radius."""
    return _compared(fps.withColumn("tile", _tile_key(fields)), _steps(fields, radius), radius, piece)


def _compared(keyed: DataFrame, steps: list[int], radius: int, piece: int) -> DataFrame:
    """Forests of the links in keyed (fp, tile): inside each tile, and between tiles whose numbers differ by one of steps."""
    counts = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    cut = keyed.join(counts, "tile").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    pieces = cut.groupBy("tile", "piece").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # about ``piece`` fingerprints each
    inner = pieces.filter(F.size("fps") > 1).select("fps", F.lit(None).cast("array<bigint>").alias("others"))
    near = pieces.select("tile", "piece", "fps", F.explode(F.array(*[F.lit(s).cast("bigint") for s in steps])).alias("step"))
    near = near.select((F.col("tile") + F.col("step")).alias("to"), "step", "piece", "fps")
    other = pieces.select(F.col("tile").alias("to"), F.col("piece").alias("other_piece"), F.col("fps").alias("others"))
    across = near.join(other, "to").filter("step != 0 OR piece < other_piece").select("fps", "others")

    @returns_memory
    def compared(batches):
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column("fps"), batch.column("others")):
                u, v = forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64) if b.is_valid else None, radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                for k in range(0, len(u), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000].view(np.int64)), pa.array(v[k : k + 100_000].view(np.int64))], names=["u", "v"])

    return inner.unionByName(across).mapInArrow(compared, "u bigint, v bigint")


def similarity(a: bytes | None, b: bytes | None, width: int = 5) -> float:
    """Jaccard similarity of the sets of ``width``-word shingles, a shorter text being one; 1 for two texts without words."""
    sets = []
    for text in (a, b):
        words = text.translate(_LOWER).split() if text else []
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


def similar(edges: DataFrame, texts: DataFrame, least: float, width: int = 5) -> DataFrame:
    """The edges (u, v) whose texts, of texts (node, text), are at least so similar."""
    a, b = (texts.select(F.col("node").alias(e), F.col("text").alias("text_" + e)) for e in ("u", "v"))
    pairs = edges.distinct().join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v")

    @returns_memory
    def checked(batches):
        for batch in batches:
            u, v = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_u", "text_v"))
            kept = pa.array([similarity(x, y, width) >= least for x, y in zip(u, v)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(kept), batch.column("v").filter(kept)], names=["u", "v"])

    return pairs.mapInArrow(checked, "u bigint, v bigint")


def similar_forest(sets: list[np.ndarray], roots: np.ndarray, least: float, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of different roots, and of different sides if given, whose sorted digest sets are at least so similar, thinned, as they are accepted, to those that connect more.

    Sets are compared only where their sizes, and their counts by the digests' first byte, allow that similarity.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    cells = np.array([np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 32767) for s in sets], dtype=np.int16)
    root, found = np.unique(roots, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        may = (root != root[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]) - 1e-6)
        may[: i + 1] = False
        if sides is not None:
            may &= sides != sides[i]
        j = np.flatnonzero(may)
        j = j[np.abs(cells[j].astype(np.int32) - cells[i]).sum(axis=1) <= (1 - least) / (1 + least) * (sizes[j] + sizes[i]) + 1e-6]
        for k in j.tolist():
            if root[k] != root[i]:
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if common / (len(sets[i]) + len(sets[k]) - common) >= least:
                    found.append((i, k))
                    root[root == root[k]] = root[i]
    return found


def similar_apart(members: DataFrame, texts: DataFrame, least: float, size: int = MEMBERS) -> DataFrame:
    """(u, v): links between the roots of members (key, hash, root) of equal keys and different roots whose texts, of texts (node, text), are at least so similar.

    All such pairs are compared, in groups of at most two pieces of a bucket, of about ``size`` members each.
    """
    mixed = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("pieces")).filter("a != b")
    cut = members.join(mixed, "key").withColumn("piece", F.pmod(F.xxhash64("hash", "key"), F.col("pieces")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("key", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "root", F.col("hash").alias("node"))

    def compared(group: pa.Table) -> pa.Table:
        sets = [np.unique(shingles(t)) for t in group.column("text").cast(pa.binary()).to_pylist()]
        roots, sides = group.column("root").to_numpy(), group.column("piece").to_numpy()
        across = group.column("p")[0].as_py() != group.column("q")[0].as_py()
        at = np.array(similar_forest(sets, roots, least, sides if across else None), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": roots[at[:, 0]], "v": roots[at[:, 1]]})

    return dealt.join(texts, "node").groupBy("key", "p", "q").applyInArrow(compared, "u bigint, v bigint")


def _classes(rows: DataFrame, radius: int, fields, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) of each distinct fingerprint of rows: its connected component over links within the radius, and more (u, v)."""
    distinct = rows.select("fp").distinct()
    edges = links(distinct, radius, fields)
    roots = spool(components(edges if more is None else edges.unionByName(more)), "roots")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, fields=FIELDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles have 3 words, a shorter text is one
    shingle; null, empty and blank texts have fingerprint 0, which links like any other. component_id is the smallest
    doc_id reachable over links of at most 2 differing bits. A null doc_id gets a row too; it is no candidate for the
    smallest, so a component of null ids has a null one. Repeated rows each get a row. An empty table gives none. Other
    columns aren't read.
    """
    rows = spool(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = classes.join(_classes(rows, radius, fields), "fp")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, fields=FIELDS, least: float = SIMILAR) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, then the smallest hash of the text; null ids come last.

    Groups are connected by fingerprints of at most ``radius`` differing bits, and by texts that have a similarity of at
    least ``least`` on five-word shingles. Texts without words are alike; an empty table gives none.

    Texts are compared where a band of their min-hashes agrees: first each with one member of the bucket, which connects
    most, then, in buckets whose members aren't connected yet, all pairs that are still apart. Every link is verified
    before any is left out.
    """
    rows = spool(fingerprints(docs, banded=True), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("hash").alias("h"))
    first = spool(rows.groupBy("fp").agg(F.min(place).alias("low")), "first")
    d, h = fresh(docs, "d", "h")
    at = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), h: F.xxhash64("text")})
    own = lambda df: df.withColumns({d: F.coalesce("low.i", F.lit(-(2**63))), h: F.col("low.h")}).drop("low")
    each = spool(rows.groupBy("hash").agg(F.min(place).alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "each")
    keyed = each.select("hash", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("hash", "key").alias("x"), "hash")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = spool(keyed.join(hubs, "key").select("key", "n", "hash", F.col("hub.hash").alias("hub")), "members")
    ends = members.select("hash").distinct()
    texts = at.select(d, h, "text").join(own(each.join(ends, "hash").select("hash", "low")), [d, h]).dropDuplicates(["hash"])
    texts = spool(texts.select(F.col("hash").alias("node"), "text"), "texts")
    near = similar(members.filter("hash != hub").select(F.least("hub", "hash").alias("u"), F.greatest("hub", "hash").alias("v")), texts, least)
    a, b = (each.select(F.col("hash").alias(e), F.col("fp").alias("fp_" + e)) for e in ("u", "v"))
    near = spool(near.join(a, "u").join(b, "v").select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")).distinct(), "near")
    classes = spool(_classes(rows, radius, fields, near), "classes")
    rest = members.filter("n > 2").join(each.join(classes, "fp").select("hash", "root"), "hash").select("key", "hash", "root")
    more = components(similar_apart(rest, texts, least)).withColumnRenamed("root", "last")
    last = classes.join(more, classes.root == more.node, "left").select("fp", F.coalesce("last", "root").alias("root"))
    kept = own(first.join(last, "fp").groupBy("root").agg(F.min("low").alias("low"))).select(d, h)
    return at.join(kept, [d, h], "left_semi").dropDuplicates([d, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
