import itertools
import random
import re

import corpus_pipeline
from lattisca.llm import pieces, simhash
from lattisca.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_shrink(spark):
    docs = table(spark, SF, "documents")
    n, columns = docs.count(), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n and out.filter("n_tokens > 0").count() > 0


def test_stages_take_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, None)], table(spark, SF, "documents").schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _lines_cut(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            if tuple(lines[k : k + 3]) in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(tuple(lines[k : k + 3]))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def _one_of_each(rows):
    def shingles(t):
        w = _lower(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    fps, sets, root = {i: simhash.fingerprint(t.encode()) for i, t in rows}, {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, _), (j, _) in itertools.combinations(rows, 2):
        both = sets[i] | sets[j]
        if (fps[i] ^ fps[j]).bit_count() <= 2 or (len(sets[i] & sets[j]) / len(both) if both else 1) >= 0.8:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return [(i, t) for i, t in rows if find(i) == i]


def _without_benchmark(rows, items):
    word, windows, out = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set(), []
    for t in items:
        w = word.findall(_lower(t))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    for i, t in rows:
        found = list(word.finditer(_lower(t)))
        w, hit = [m[0] for m in found], set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        for a in sorted((k for k in hit if k - 1 not in hit), reverse=True):
            b = next(k for k in range(a, len(w) + 1) if k not in hit)
            t = t[: found[a].start()] + t[found[b - 1].end() :]
        out.append((i, t))
    return out


def test_pipeline_against_plain_versions(spark, tmp_path):
    """Planted toxic documents, repeated lines, copies near and exact, and benchmark passages; every stage against brute force."""
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    vile = lambda: " ".join([prose(20), rng.choice(("grumxxy", "grumzzt", "vileword")), "you", rng.choice(("grumxxy", "vileword")), prose(20)])
    item, notice = prose(30), "\n".join(prose(6) for _ in range(4))
    rows = [(k, prose(rng.randrange(30, 90))) for k in range(80)] + [(100 + k, vile()) for k in range(30)]
    base = prose(120).split()
    for k in range(12):
        edited = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            edited[at] = f"v{rng.randrange(4000)}"
        rows.append((200 + k, " ".join(edited)))
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, prose(10) + " " + item), (303, prose(600) + " " + " ".join(item.split()[5:25]) + " " + prose(10)), (304, ""), (305, prose(3))]
    rows += [(400 + k, f"{prose(30)}\n{notice}\n{prose(30)}") for k in range(4)]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 130)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, want = table(spark, path, "documents"), [(i, t) for i, t in rows if not 100 <= i < 130]
    plain = [lambda x: x, _lines_cut, _one_of_each, lambda x: _without_benchmark(x, [item])]
    for (name, stage), check in zip(corpus_pipeline.STAGES, plain):
        got, want = stage(spark, docs, path), check(want)
        kept = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect())
        assert kept == sorted((i, t, len(t)) for i, t in want), name
        docs = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in kept], docs.schema)
    vocabulary = pieces.Vocabulary.load()
    out = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, path).collect()}
    assert out == {i: vocabulary.encode(t, 1)[0][1] for i, t in want}
    assert 303 in out and not {300, 301, 302} & set(out) and sum(200 <= i < 300 for i in out) < 12
