"""Each operator against a plain version of its definition, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattisca.llm import ann, chat, components, decontam, linededup, ngram, pieces, repeats, sharding, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(5)
_VOCAB = ["ab", "Cd", "e", "fgh", "ij", "été", "k9", "l", "mn.", "o"]
_LONG = " ".join(random.choice(_VOCAB) for _ in range(4000))
_PASSAGE = " ".join(f"w{i}" for i in range(80))


def _texts():
    rows = [" ".join(random.choice(_VOCAB) for _ in range(random.randrange(1, 120))) for _ in range(40)]
    rows += [rows[0], rows[0], rows[1] + " x", f"start {_PASSAGE} end", f"other beginning here {_PASSAGE[:400]} cut", _LONG, _LONG[5000:15000]]
    rows += [None, "", " \n\t ", "a\nb\nc\nd\na\nb\nc", "x\ny\na\nb\nc\nd", "l1\nl2\nl3", "l1\nl2\nl3"]
    return rows


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3 + 1, t) for i, t in enumerate(_texts())]
    return [*out, out[3], (None, out[4][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    # Names that operators use themselves must not get in the way.
    return made.withColumns({c: F.lit("own") for c in ("fp", "chunk", "bucket", "d", "H", "gone", "__x", "__d", "__h", "__gone", "a", "b", "hash", "key")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def id_order(i):
    return (0, 0) if i is None else (1, i)


# 1


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(1)
    sizes, trans = np.array([1, 0, 7, 300, 128]), rng.normal(size=(2, 2))
    odds = rng.normal(size=sizes.sum())
    got, at = toxicity.Chain(odds, sizes, trans, segment=16).marginal, 0
    for n in sizes:
        psi = np.stack([np.ones(n), np.exp(odds[at : at + n])], axis=1)
        a, f, b = np.exp(trans), np.zeros((n, 2)), np.ones((n, 2))
        v = np.array([1.0, 0.0])
        for t in range(n):
            v = (v @ a) * psi[t]
            v /= v.sum()
            f[t] = v
        for t in range(n - 2, -1, -1):
            b[t] = a @ (psi[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(got[at : at + n], want[:, 1] / want.sum(axis=1)) if n else True
        at += n


def _labelled(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        own = [rng.choice(["alpha", "beta", "gamma", "delta", "gruma"]) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), rng.choice(["Vileword", "grumxxy", "grumzzt"]))
        out.append((i, " ".join(own), int(bad)))
    return out


def test_toxicity_learns_and_tags(spark):
    rows = _labelled()
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "alpha"), (1002, "alpha " * 5000 + "vileword")], "doc_id bigint, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    unseen = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y for i, _, y in unseen) >= 0.97 * len(unseen)
    i, t, _ = next(r for r in unseen if r[2])
    assert {t[s.start : s.stop].lower() for s in got[i].spans} <= {"vileword", "grumxxy", "grumzzt"} and got[i].spans
    assert got[1000].predicted == got[1001].predicted == 0 and 0 <= got[1000].score <= 1 and got[1002].spans[-1].start == 30000


def test_toxic_spans_survive_lower_case(spark):
    """A letter whose lower case is longer moves no offset."""
    rows = _labelled()
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, "\u0130stanbul alpha Vileword beta")], "doc_id bigint, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int"))
    got = toxicity.score(d.filter("doc_id = 2000"), model).first()
    assert [(s.start, s.stop) for s in got.spans] == [(15, 23)] and got.predicted == 1
    small = toxicity.train(d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int"), most_bytes=3000)
    assert 0 <= toxicity.score(d, small).agg(F.min("score")).first()[0] <= 1


def test_tokens_are_labelled_given_a_toxic_document():
    """Expected transitions and the probability of no toxic token, against all labellings of short texts."""
    rng = np.random.default_rng(3)
    sizes, trans = np.array([3, 0, 5]), rng.normal(size=(2, 2))
    odds, weights = rng.normal(size=8), np.array([1.0, 1.0, 2.0])
    chain, at, pairs = toxicity.Chain(odds, sizes, trans, segment=2, weights=weights), 0, np.zeros((2, 2))
    for n, w, clean in zip(sizes, weights, chain.clean):
        total, none, own = 0.0, 0.0, np.zeros((2, 2))
        for way in range(2**n):
            y = [way >> k & 1 for k in range(n)]
            score = np.exp(sum(trans[a, b] + b * odds[at + k] for k, (a, b) in enumerate(zip([0, *y], y))))
            total, none = total + score, none + score * (not any(y))
            for a, b in zip([0, *y], y):
                own[a, b] += score
        assert np.isclose(np.exp(clean), none / total)
        pairs, at = pairs + w * own / total, at + n
    assert np.allclose(chain.pairs, pairs)


def test_toxicity_without_labels(spark, none):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    model = toxicity.train(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.score(d, model).first().predicted == 0
    assert toxicity.score(none, model).count() == 0


# 2


def test_sharding(spark, docs, rows, none):
    got = sharding.shard(docs, 4, 64).collect()
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert sharding.shard(none).count() == 0


def test_sharding_balances_and_rebalances(spark, tmp_path):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    sized = sharding.sized(d, 512)
    table = sharding.slot_bytes(sized, 512)
    first = sharding.first_map(table, 8)
    totals = [r.b for r in first.groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()]
    assert len(totals) == 8 and max(totals) - min(totals) < 200
    path = str(tmp_path / "m")
    assert sharding.save_map(first, path) == 1
    with pytest.raises(ValueError):
        sharding.save_map(first, path)
    with pytest.raises(ValueError):
        sharding.save_map(first.filter("slot != 7"), path + "x")
    grown = sharding.rebalance(sharding.load_map(spark, path), table, 9)
    assert sharding.save_map(grown, path) == 2 and sharding.versions(spark, path) == [1, 2]
    old, new = ({r.slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    moved = [s for s in old if old[s] != new[s]]
    assert old.keys() == new.keys() == set(range(512)) and 0 < len(moved) < len(old) / 3 and len(set(new.values())) == 9
    totals = [r.b for r in sharding.load_map(spark, path).groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()]
    assert max(totals) < 1.1 * min(totals)


def test_a_stored_map_serves_other_rows(spark, tmp_path):
    """A map of few rows takes many more, loses none, and is edited where they don't lie even."""
    rows = lambda n, size: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id") % size).alias("text"))
    path = str(tmp_path / "m")
    assert sharding.shard(rows(100, 50), 4, 256, path).count() == 100 and sharding.versions(spark, path) == [1]
    for n, size in ((3000, 50), (40, 3), (3000, 50)):
        got = sharding.shard(rows(n, size), 4, 256, path).collect()
        by, of = {}, sharding.load_map(spark, path).collect()
        for r in got:
            by.setdefault(r.shard, []).append(r)
        assert len(got) == n and set(by) <= {0, 1, 2, 3} and len(of) == 256
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        sizes = [sum(r["size"] for r in own) for own in by.values()]
        assert n < 100 or len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
    assert len(sharding.versions(spark, path)) > 1


def test_sharding_deals_as_told(spark, docs, rows):
    """Places, slots and shards against a plain version."""
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 64
    loads, to, held = [0] * 4, {}, {s: 0 for s in range(64)}
    for i, t in rows:
        held[slot(i)] += len((t or "").encode()) + 1
    for s in sorted(held, key=lambda s: (-max(held[s], 1), s)):
        to[s] = loads.index(min(loads))
        loads[to[s]] += max(held[s], 1)
    got = sharding.shard(docs, 4, 64).collect()
    assert all(r.shard == to[slot(r.doc_id)] for r in got)
    order = sorted(got, key=lambda r: (r.virtual_slot, id_order(r.doc_id), r.text_crc32, r["size"]))
    assert all([r.slot for r in order if r.shard == k] == list(range(sum(r.shard == k for r in got))) for k in range(4))


# 3


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 5, 400)
    index = decontam.FmIndex(seq, 5, sample=7)
    for n in (1, 2, 3):
        phrases = rng.integers(1, 5, (20, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_windows_of_a_block_are_small():
    """A block of benchmark text of its full size takes a bounded table: window ids, and a number for each item that holds one."""
    rng = random.Random(8)
    items = [(str(k), " ".join(f"w{rng.randrange(30000)}" for _ in range(60)).encode()) for k in range(2000)] + [("short", b"w1 w2")]
    found = decontam.Phrases(items)
    assert [(n, len(p)) for n, _, p in found.by_length] == [(2, 1), (13, 2000 * 48)]
    assert sum(p.nbytes for _, _, p in found.by_length) + found.first.nbytes + found.owners.nbytes < 10_000_000
    words = [found.vocabulary[w] for w in items[5][1].split()[10:40]]
    ids = np.array([0, *words, 0, found.vocabulary[b"w1"], found.vocabulary[b"w2"], 0])
    at, length, number = found.hits(ids, np.zeros(len(ids), dtype=np.int64))
    assert sorted(zip(at.tolist(), length.tolist())) == sorted([(32, 2), *[(k, 13) for k in range(1, 19)]]) and found.items(np.unique(number)) == ["5", "short"]


def test_decontamination(spark, docs, rows, none):
    bench = [(7, _PASSAGE[:200]), (8, "AB cd"), (10, _PASSAGE.upper()), (11, None), (12, "..."), (None, "fgh ij")]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in bench:
        w = re.findall(rx, lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for options in ({}, {"block_bytes": 200, "shard_words": 50}):
        found = decontam.find_phrases(docs, table, **options)
        got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(found).collect()), key=str)
        want = []
        for i, t in rows:
            w, hit, items = re.findall(rx, lower(t)), set(), set()
            for p, own in windows.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        items |= own
            items = sorted(str(x) for x in items - {None})
            want.append((i or 0, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
        assert got == sorted(want, key=str)
    cut = {r.doc_id: r.text for r in decontam.find_phrases(docs, table, cut=True, block_bytes=200).collect()}
    assert next(v for k, v in cut.items() if v and v.startswith("start")) == "start  end"
    assert decontam.find_phrases(none, table).count() == 0 and decontam.find_phrases(docs, table.limit(0)).filter("n_hit > 0").count() == 0


# 4


HARD = ["\\### Assistant: </turn> ok", "### a: b </turn>\n", "\\\\", "", "a:b\nc", "<#\\", "é😀"]


def test_chat_round_trip():
    turns = [(r, t) for r in ["user", "assistant", "odd: role\n#", ""] for t in HARD]
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns
    piece, a, b = chat.render("assistant", HARD[0])
    assert chat.unescape(piece[a:b]) == HARD[0]


def test_chat_folds_events(spark):
    log = [
        (1, "m1", 1, "open", "user", ""), (1, "m1", 2, "delta", "user", "hel"), (1, "m1", 4, "delta", None, "lo"),
        (1, "m2", 5, "open", "assistant", None), (1, "m2", 6, "delta", None, "bad"), (1, "m2", 9, "regenerate", None, "go"), (1, "m2", 10, "delta", None, "od"),
        (1, "m3", 7, "open", "user", "typo"), (1, "m3", 11, "edit", None, "fixed"), (2, "m1", 1, "open", "user", "x"), (2, "m1", 2, "delete", None, None), (2, "m9", 3, "open", "user", "y"),
    ]
    random.shuffle(log)
    made = chat.reconstruct(spark.createDataFrame(log, chat.EVENTS).repartition(3)).orderBy("conv_id", "seq").collect()
    assert [chat.parse(r.piece) for r in made] == [[("user", "hello")], [("assistant", "good")], [("user", "fixed")], [("user", "y")]]


def test_chat_digest(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", HARD[0]), (1, 1, "assistant", HARD[0]), (2, 5, None, None), (None, 1, "assistant", "z"), (3, None, "user", "q"), (3, 2, "assistant", None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit(1))).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (id_order(x[1]), x[2] or ""))]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(a, b)[0]) for a, b in own)
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# 5


def _fingerprint(t):
    w = words(lower(t))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    fps = sorted({_fingerprint(t) for _, t in rows})
    root = {f: f for f in fps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        if i is not None:
            f = find(_fingerprint(t))
            low[f] = min(low.get(f, i), i)
    want = sorted(((i or 0, f"{_fingerprint(t):016x}", low.get(find(_fingerprint(t)))) for i, t in rows), key=str)
    assert sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = simhash.representatives(docs, least=1.1).collect()
    assert len(kept) == len({find(_fingerprint(t)) for _, t in rows}) and {r.doc_id for r in kept} == set(low.values())
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def test_simhash_links_by_tiles(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(5):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), piece=3)).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    linked = {r.node: r.root for r in got}
    assert all(linked.get(f, f) == find(f) for f in fps)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, None), (3000, 2999), (2999, 3000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and got[3000] == 2999 and len(got) == 253


# 6


def test_line_dedup(docs, rows, none):
    unique = sorted(set(rows), key=lambda r: id_order(r[0]))
    seen, gone = set(), {}
    for i, t in unique:
        lines = (t or "").split("\n") if t is not None else []
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone.setdefault((i, t), set()).update((k, k + 1, k + 2))
            seen.add(w)
    got = linededup.line_dedup(docs.withColumn("n_lines", F.lit(7))).collect()
    want = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        g = gone.get((i, t), set())
        want.append((i or 0, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines), len(g)))
    assert sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in got), key=str) == sorted(want, key=str)
    assert any(gone.values()) and linededup.line_dedup(none).count() == 0


# 7


def _vocabulary():
    rng = random.Random(4)
    texts = {"▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "▁▁", "aa"}
    return pieces.Vocabulary([(t, -rng.random() * 10) for t in sorted(texts)], list(range(300, 300 + len(texts))), list(range(256)))


def _all_ways(v, chunk):
    edges = v.lattice(chunk)

    def back(j):
        return [(0.0, [])] if j == 0 else [(s + score, [*x, label]) for i, score, label in edges[j] for s, x in back(i)]

    return sorted((s for s, _ in back(len(chunk))), reverse=True)


def test_n_best_is_exact_and_round_trips():
    v = _vocabulary()
    for text in ["abcabc", "a b", "ab ca  bc", "a\nb", "zab", "▁a é", "aaaa a", " "]:
        found = v.encode(text, 4)
        want = _all_ways(v, " " + text)[:4]
        assert np.allclose([s for s, _ in found], want) and len({tuple(i) for _, i in found}) == len(found)
        assert all(v.decode(i) == text for _, i in found)
        scores, ids, others = v.ranked(text, 4, pieces.Chunks(v))
        assert np.allclose(scores, want) and [ids, *[pieces.edited(ids, e) for e in others]] == [i for _, i in found]


def test_text_with_ascii_bytes_needs_no_detour():
    # A line break is no piece of the vocabulary but a byte, and nearly every document has one.
    v = pieces.Vocabulary.load()
    cache, texts = pieces.Chunks(v), ["a\nb\n\nc d", "\tx\x00 y\n", "naïve \n ▁ 日本 \U0001f600\n", "", " "]
    for text in texts:
        scores, ids, others = v.packed(text, 3, cache)
        assert (scores, np.frombuffer(ids, dtype=np.int32).tolist(), others) == v.ranked(text, 3, cache)
        assert v.encode(text, 1, cache)[0][1] == v.ranked(text, 3, cache)[1] and v.decode(v.encode(text, 1, cache)[0][1]) == text
    assert all(isinstance(ids, bytes) for ids, _, _ in cache.values())
    plain = [v.encode(t, 1)[0][1] for t in texts[:2]]
    assert all(any(i in v.byte_of for i in ids) for ids in plain)
    v.byte_of = {}
    assert [v.decode(ids) for ids in plain] == texts[:2]


def test_encoding_table(spark, docs, rows, none):
    got = pieces.encode_table(docs.withColumn("ids", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r.decoded == r.text and r.n_tokens == len(r.ids or []) for r in got)
    assert all((r.ids is None) == (r.text is None) for r in got) and all(r.scores == sorted(r.scores, reverse=True) for r in got if r.text)
    v = pieces.Vocabulary.load()
    assert all(len(r.others) == len(r.scores) - 1 and all(v.decode(pieces.edited(r.ids, [(e.start, e.stop, e.ids) for e in way])) == r.text for way in r.others) for r in got if r.text)
    assert pieces.encode_table(none).count() == 0


# 8


def test_nearest(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(200)]
    vectors += [(200 + i, vectors[5][1]) for i in range(40)] + [(300, [0.0] * 16), (301, None), (302, [float("nan")] * 16), (303, [None] * 16), (320, [1.0] * 4), (321, [2.0] * 4), (340, [float("inf")] * 16), (None, vectors[0][1])]
    got = {}
    for r in ann.search_table(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    for q, x in fine:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(y) == len(x))[:20]
            assert [(i, n) for n, i, _ in sorted(got[q])] == [(i, k + 1) for k, (_, i) in enumerate(want)]
            assert np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in want])
    assert ann.search_table(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    whole, cut = (sorted(map(tuple, ann.nearest(table, table.filter("vec_id % 20 = 0"), block=size).collect())) for size in (ann.BLOCK, 3))
    assert whole == cut and len(whole) == sum(map(len, got.values()))


# 9


def test_language_model(spark, docs, rows, none):
    got = {}
    for options in ({}, {"chunk": 2000, "bucket": 5000}):
        got[len(options)] = sorted(((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram.score_texts(docs, **options).collect()), key=str)
    assert got[0] == got[2]
    tokens = [(i, [*words(lower(t)), None]) for i, t in rows]
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    count = {}
    for i, own in tokens:
        for w in own if part(i) != 2 else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(((i or 0, part(i) == 2, len(own), sum(w in count for w in own), n, round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own), 6)) for i, own in tokens), key=str)
    assert [r[:6] for r in got[0]] == want and all(r[6] < 0 for r in got[0])
    assert ngram.score_texts(none).count() == 0
    unseen = ngram.score_texts(docs.filter("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert unseen and all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in unseen)


def test_language_model_probabilities_add_up():
    weights = ngram.fit_weights(np.array([[3, 1040, 1008, 1000, 50], [3, -1, 1004, 1000, 20], [0, -1, 1000, 1000, 9]], dtype=float), [0.4, 0.5, 0.1])
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0 and weights[3, 0] > weights[5, 0]


def _plain_model(tokens, part):
    """Scores by dictionaries, and by EM over each held-out token."""
    train = {i: own for i, own in tokens if part(i) != 2}

    def counted(texts):
        one, two, three, contexts = {}, {}, {}, {}
        for own in texts:
            for k, w in enumerate(own):
                u, v = own[k - 2] if k > 1 else ("begin",), own[k - 1] if k else ("begin",)
                one[w] = one.get(w, 0) + 1
                contexts[v if k else ("begin",)] = contexts.get(v if k else ("begin",), 0) + 1
                two[k == 0, v, w] = two.get((k == 0, v, w), 0) + 1
                if k:
                    three[k == 1, u, v, w] = three.get((k == 1, u, v, w), 0) + 1
        return one, two, three, contexts, sum(one.values())

    def parts(own, model):
        one, two, three, contexts, n = model
        for k, w in enumerate(own):
            u, v = own[k - 2] if k > 1 else ("begin",), own[k - 1] if k else ("begin",)
            c1 = contexts.get(v if k else ("begin",), 0)
            c2 = two.get((k == 1, u, v), 0) if k else 0
            yield c2, c1, three.get((k == 1, u, v, w), 0) / c2 if c2 and k else 0, two.get((k == 0, v, w), 0) / c1 if c1 else 0, one.get(w, 0) / n

    full, kept = counted(train.values()), counted(own for i, own in train.items() if part(i) != 6)
    uniform = 1 / (len(full[0]) + 1)
    unseen = [p for i, own in train.items() if part(i) == 6 for p in parts(own, kept)]
    level = lambda c: c.bit_length()

    def em(rows, start):
        lam = list(start)
        for _ in range(ngram.ROUNDS):
            new = list(start)
            for row in rows:
                share = [a * b for a, b in zip(lam, row)]
                new = [a + b / sum(share) for a, b in zip(new, share)]
            lam = [max(a / sum(new), 1e-6) for a in new]
        return lam

    low = {c: em([(b, a, uniform) for _, c1, _, b, a in unseen if level(c1) == c], (0.4, 0.5, 0.1)) for c in range(24)}
    low[0] = [0, low[0][1], low[0][2]]
    low = {c: [a / sum(v) for a in v] for c, v in low.items()}
    below = lambda c1, b, a: sum(p * q for p, q in zip(low[level(c1)], (b, a, uniform)))
    high = {c: em([(t, below(c1, b, a)) for c2, c1, t, b, a in unseen if level(c2) == c], (0.4, 0.6))[0] if c else 0 for c in range(24)}
    return {i: sum(np.log10(high[level(c2)] * t + (1 - high[level(c2)]) * below(c1, b, a)) for c2, c1, t, b, a in parts(own, full)) for i, own in tokens}


def test_language_model_scores(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [(i, " ".join(vocabulary[k] for k in np.minimum(rng.geometric(0.12, size=30), 40) - 1)) for i in range(60)]
    texts = [*texts, *((100 + i, texts[i][1]) for i in range(0, 60, 9)), (200, ""), (201, None), (202, "^ ^^ unheard")]
    part = lambda i: zlib.crc32(str(i).encode()) % 7
    want = _plain_model([(i, [*words(lower(t)), None]) for i, t in texts], part)
    got = {r.doc_id: r.score for r in ngram.score_texts(spark.createDataFrame(texts, "doc_id bigint, text string"), chunk=2000, bucket=4000).collect()}
    assert set(got) == set(want) and all(abs(got[i] - s) <= 0.01 * abs(s) + 1e-6 for i, s in want.items())
    twice = [i for i, _ in texts[:60:9] if part(i) != 2 and part(100 + i) != 2]
    once = [i for i, _ in texts[:60] if i % 9 and part(i) != 2]
    assert np.mean([got[i] for i in twice]) > np.mean([got[i] for i in once])


def _worker_mb():
    """Of each Python worker of the session, the memory it holds now."""
    psutil = pytest.importorskip("psutil")
    held = [re.findall(r"\nPss_Anon:\s+(\d+)", open(f"/proc/{p.pid}/smaps_rollup").read()) for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
    return [int(mb) / 1024 for own in held for mb in own]


def test_language_model_leaves_workers_small(spark):
    # Idle workers share an executor's memory with those of the next stage: after chunks of 6 MB they kept all that they had ever held.
    rng = np.random.default_rng(3)
    texts = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 300_000, 40_000))) for i in range(48)], "doc_id bigint, text string").coalesce(1)
    before = max(_worker_mb(), default=0)
    assert ngram.score_texts(texts).count() == 48
    after = max(_worker_mb())
    assert after < max(before, 80) + 50, after


# 10


def test_substring_dedup(docs, rows, none):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want, removed = [], 0
    for i, t in rows:
        w, g = words(t), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                g.update(range(k, k + 50))
        removed += len(g)
        want.append((i or 0, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()))
    for options in ({}, {"chunk": 3000, "bucket": 4000}):
        got = repeats.remove_repeats(docs, **options).collect()
        assert sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    assert removed > 1000 and repeats.remove_repeats(none).count() == 0


def test_representatives_join_similar_texts(spark):
    base = [f"word{i}" for i in range(300)]
    edit = lambda *at: " ".join(f"other{i}" if i in at else w for i, w in enumerate(base))
    far = " ".join(f"far{i}" for i in range(200))
    rows = [(9, edit()), (4, edit(7, 150)), (6, edit(5)), (5, edit(*range(0, 300, 6))), (8, far), (7, far), (7, far), (None, far), (3, ""), (2, None)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit(0)))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7]
    assert simhash.similarity(edit().encode(), edit(7).encode()) == pytest.approx(291 / 301)
    assert simhash.similarity(None, b" ") == 1.0 and simhash.similarity(b"A b", b"a  B") == 1.0 and simhash.similarity(b"a", None) == 0.0
