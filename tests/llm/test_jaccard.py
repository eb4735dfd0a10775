import random
import re

import pytest

from lakeglean.llm import jaccard


def brute(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    passage = [rng.choice(word) for _ in range(60)]
    base = [rng.choice(word) for _ in range(90)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one two three four"), (6, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f")]
    for i in range(10, 60):  # near copies of one text
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(word)
        rows.append((i, " ".join(t)))
    for i in range(60, 110):  # one passage in texts of many lengths
        t = [rng.choice(word) for _ in range(rng.randrange(0, 40))] + passage + [rng.choice(word) for _ in range(rng.randrange(0, 12))]
        rows.append((i, " ".join(t)))
    for i in range(110, 140):  # cut copies
        rows.append((i, " ".join(base[: rng.randrange(10, 90)])))
    for i in range(140, 170):
        rows.append((i, " ".join(rng.choice(word) for _ in range(rng.randrange(1, 30)))))
    rows += [(i, "x y z u v w " * 3) for i in range(170, 190)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "rare", "often"), [(1, 1000, 8), (2, 3, 2), (3, 2, 1), (4, 10, 3)])
def test_matches_brute_force(spark, seed, rare, often):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_classes(df, hot_tokens=64, rare=rare, often=often).collect()}
    assert got == brute(rows)


def test_all_links_match_brute_force(spark):
    rows = corpus(5)
    sets = {}
    for i, text in sorted(rows):
        w = (text or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if s:
            sets.setdefault(s, i)
    want = {tuple(sorted((sets[a], sets[b]))) for a in sets for b in sets if sets[a] < sets[b] and 100 * len(a & b) >= 75 * len(a | b)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.shingle_links(df, hot_tokens=64, rare=5, often=2).collect()
    assert {tuple(sorted((r["doc_a"], r["doc_b"]))) for r in got} == want and len(got) == len(want) > 100


def test_empty_table_extra_columns_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string, n int")
    assert jaccard.shingle_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", "x", 1), (5, "a b c d e", "y", 2), (5, "a b c d e", "y", 2), (7, None, "z", 3)], "doc_id long, text string, node string, n int")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in jaccard.shingle_classes(df).collect())
    assert got == [(-1, 1, 5), (5, 1, 5), (5, 1, 5), (7, 0, 7)]


def test_a_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.shingle_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_block_of_few_words(n):
    import numpy as np
    import pyarrow as pa

    from lakeglean.llm import words

    for texts in (["w x y z v"[: 2 * n - 1]], [None, "w x y z v"[: 2 * n - 1], ""]):
        hashes, before = words.word_hashes(*words.buffers(pa.array(texts, pa.string())))
        shingles, at = words.shingle_hashes(hashes, before)
        assert len(hashes) == n and len(shingles) == 1 and at[-1] == 1 and shingles.dtype == np.uint64
