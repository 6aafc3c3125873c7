import random
from itertools import combinations

import numpy as np

from lattisca.llm import simhash


def _kept(rows):
    """Smallest ids of the groups that brute force finds: fingerprints of at most 2 differing bits, or a similarity of 0.8."""
    fps, root = {i: simhash.fingerprint(t.encode()) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if find(i) != find(j) and ((fps[i] ^ fps[j]).bit_count() <= 2 or simhash.similarity(a.encode(), b.encode()) >= 0.8):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return sorted({find(i) for i in root})


def _edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"w{rng.randrange(5000)}"
    return words


def test_pairs_at_080_to_090_are_joined(spark):
    rng, rows, far, near = random.Random(5), [], 0, 0
    while near < 120:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        a, b = " ".join(base), " ".join(_edited(rng, base, rng.randrange(1, len(base) // 40 + 2)))
        if 0.8 <= simhash.similarity(a.encode(), b.encode()) < 0.9:
            rows += [(2 * near, a), (2 * near + 1, b)]
            far += (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 6
            near += 1
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert far > 20 and sorted(r.doc_id for r in kept) == list(range(0, 240, 2))


def test_dense_groups_of_edited_copies(spark):
    rng, rows = random.Random(6), []
    for g in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows += [(100 * g + k, " ".join(_edited(rng, base, rng.randrange(5)))) for k in range(60)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == _kept(rows)


def test_pieces_of_a_bucket_are_compared_with_each_other(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(_edited(rng, base, rng.randrange(5))) for _ in range(40)]
    members = spark.createDataFrame([(1, k, k) for k in range(40)], "key bigint, hash bigint, root bigint")
    got = simhash.similar_apart(members, spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 0.8, size=6)
    links = {(i, j) for i, j in combinations(range(40), 2) if simhash.similarity(texts[i].encode(), texts[j].encode()) >= 0.8}

    def groups(pairs):
        root = np.arange(40)
        for u, v in pairs:
            root[root == root[u]] = root[v]
        return {tuple(np.flatnonzero(root == r)) for r in root}

    found = {tuple(sorted((r.u, r.v))) for r in got.collect()}
    assert found <= links and groups(found) == groups(links)
