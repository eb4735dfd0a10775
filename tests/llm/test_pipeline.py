"""The stages of the pipeline, one after the other, against plain versions on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from lakeglean.llm import registry, toxicity


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(240):
        t = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["zzidiot", "qqmoron"]) + rng.choice(["", "s"]))
        if i % 7 == 1:
            t.insert(0, "token=abcdefghijklmnop")
        docs.append([i, " ".join(t), "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for k, i in enumerate(range(1, 60, 6)):  # exact and near copies
        docs.append([1000 + k, docs[i][1] if k % 2 else docs[i][1].upper(), "en", "s0", 0])
    docs += [[2000, None, None, None, None], [2001, "", "en", None, 0], [2000, None, None, None, None]]
    return [tuple(d) for d in docs], labels


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
        d.write.parquet(f"{tmp_path}/out-{name}")
        d = spark.read.parquet(f"{tmp_path}/out-{name}")
        steps[name] = d.collect()
        if name != "packing":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    truth = {i: t for i, _, t in labels}
    kept = {r["doc_id"] for r in steps["toxicity"]}
    assert sum(i in kept for i, t in truth.items() if not t) >= 0.99 * sum(not t for t in truth.values())
    assert sum(i in kept for i, t in truth.items() if t) <= 2 and {2000, 2001} <= kept
    # near duplicates: the smallest id of each component of the brute-force graph, and wordless ones
    sets = {r["doc_id"]: shingles(r["text"]) for r in steps["toxicity"]}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    assert sorted(r["doc_id"] for r in steps["near_duplicates"]) == sorted(i for i in sets if find(i) == i)
    assert not any(re.search(r"token=[a-z]{12}", r["text"] or "") for r in steps["secrets"])
    assert Counter(r["doc_id"] for r in steps["secrets"]) == Counter(r["doc_id"] for r in steps["near_duplicates"])
    before = {r["doc_id"]: r["text"] for r in steps["near_duplicates"]}
    for r in steps["secrets"]:
        if "token=" not in (before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in steps["secrets"]}
    taken = Counter(r["doc_id"] for r in steps["mixing"])
    assert set(taken) <= {i for i, n in sizes.items() if n} and max(taken.values()) <= 3
    assert sum(sizes.values()) - 3 * 60 * 5 <= sum(sizes[i] * n for i, n in taken.items()) <= sum(sizes.values())
    pieces = defaultdict(int)
    for r in steps["packing"]:
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: sizes[i] * n for i, n in taken.items()}
    out = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in out.collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in steps["packing"])


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]
    assert set(registry.oracle_sql()) <= set(names) and toxicity.THRESHOLD == 0.7


def test_null_and_shared_ids_keep_their_texts(spark):
    rng = random.Random(5)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(5)]
    rows = [(None, text[0]), (1, text[1]), (1, text[2]), (2, text[2].upper()), (None, text[2]), (None, text[3]), (None, text[3]), (None, None), (3, text[4])]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect())
    assert kept == sorted([(0, text[0]), (1, text[1]), (1, text[2]), (0, text[3]), (0, ""), (3, text[4])])
    taken = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, d, "").collect())
    assert taken == Counter((i, t) for i, t in rows if t)
