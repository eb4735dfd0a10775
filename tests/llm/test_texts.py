import itertools
import random

import numpy as np
import pytest

from lakeglean.llm import chat, fingerprint, htmltext, images, quality, toxicity


# -- fingerprints ------------------------------------------------------------------------------------


def slow_signature(text, slots=fingerprint.SLOTS, order=fingerprint.ORDER, k=fingerprint.K):
    """Order MinHash straight from its definition, on the same k-mer hashes."""
    out = np.zeros(slots, np.uint16)
    if not text:
        return out
    h = fingerprint.numbered(fingerprint.kmer_hashes(np.frombuffer(text, np.uint8), k))
    by = {}
    for pos, x in enumerate(h.tolist()):
        by.setdefault(x >> (64 - slots.bit_length() + 1), []).append((x, pos))
    for s, items in by.items():
        chosen = sorted(sorted(items)[:order], key=lambda x: x[1])
        total = np.zeros(1, np.uint64)
        for x, _ in chosen:
            total = fingerprint.mix(total * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(x))
        out[s] = int(total[0] % np.uint64(65535)) + 1
    return out


def test_signature_matches_definition():
    rng = random.Random(3)
    for n in (1, 5, 12, 13, 40, 700, 5000):
        text = "".join(rng.choice("ab c") for _ in range(n)).encode()
        assert (fingerprint.signature(text) == slow_signature(text)).all()


def test_kmer_hashes_depend_on_their_window_only():
    a = fingerprint.kmer_hashes(np.frombuffer(b"xxhello world, hello world", np.uint8))
    b = fingerprint.kmer_hashes(np.frombuffer(b"hello world, hello", np.uint8))
    assert b[0] == a[2]


def test_fingerprints_against_plain_order(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdé 😀") for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(100, None), (101, ""), (None, "null id"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect() if r["doc_id"] != 7}
    order = sorted((i for i, _ in rows if i is not None and i != 7), reverse=True)
    texts = dict(rows)
    for a, b in itertools.pairwise(order):
        if 7 in range(b, a):
            continue
        own, nxt = texts[a] or "", texts[b] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + nxt[:m]
        assert got[a]["n_chars"] == len(own)
        assert got[a]["edited_fingerprint"] == fingerprint._hex(fingerprint.signature(edited.encode()))
    assert got[None]["near_next"] == fingerprint.likeness(fingerprint.signature(b"null id"), fingerprint.signature(b""))
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and len(one) == 1


def test_every_column_against_a_plain_version(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(rng.choice([None, *range(-40, 40)]), "".join(rng.choice("abcdé 😀") for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    rows += [(3, "one " * 40_000)] * 3 + [(None, None), (2**63 - 1, "top"), (-(2**63), "low"), (7, None), (7, "")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(7)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for (i, own), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        own, nxt = own or "", nxt or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + nxt[:m]
        a, b, c = (slow_signature(x.encode()) if len(x) < 5000 else fingerprint.signature(x.encode()) for x in (own, edited, nxt))
        want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), fingerprint._hex(a), fingerprint._hex(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    for size in (fingerprint.RANGE_BYTES, 200):
        got = fingerprint.fingerprints(df, range_bytes=size)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# -- toxicity ---------------------------------------------------------------------------------------


def brute_segments(scores):
    """Maximal scoring segments by repeated search for the best positive segment."""
    out = []

    def part(lo, hi):
        best = None
        for a in range(lo, hi):
            t = 0.0
            for b in range(a, hi):
                t += scores[b]
                if t > 1e-12 and (best is None or t > best[0] + 1e-12):
                    best = (t, a, b + 1)
        if best:
            t, a, b = best
            part(lo, a)
            out.append((a, b, t))
            part(b, hi)

    part(0, len(scores))
    return out


def test_linear_scan_finds_all_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        hits = sorted((i, rng.choice([0.3, 0.7, 1.1, 2.9])) for i in rng.sample(range(20), rng.randrange(0, 8)))
        scores = [-0.25] * 20
        for i, w in hits:
            scores[i] = w
        got, want = toxicity.maximal_segments(hits, 0.25), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def toxic_corpus(n=600):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["zzidiot", "qqmoron", "vvclown"]) + rng.choice(["", "s", "en"]))
        docs.append((i, " ".join(t), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame([*docs, (9000, None, "x"), (9001, "", "x"), (None, "zzidiot qqmoron vvclown", "x"), (0, docs[0][1], "x"), (9002, "word " * 100_000, "x")], "doc_id long, text string, score string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, l)
    got = {r["doc_id"]: r for r in toxicity.scored(d, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and got[None]["predicted"] == 1 and 0 <= got[9002]["score"] < 0.7
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.where("doc_id = 9001").count() == 1
    none = toxicity.fit(d, l.limit(0))
    assert {r["predicted"] for r in toxicity.scored(d.limit(5), none).collect()} == {0}
    assert toxicity.scored(d.limit(0), model).count() == 0


def test_weights_law_and_score_against_their_definitions(spark):
    import math
    import zlib
    from collections import Counter

    docs, labels = toxic_corpus(240)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    n, by = [0, 0], [Counter(), Counter()]
    for (i, text, _), (_, _, y) in zip(docs, labels, strict=True):
        if zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        for w, c in Counter(text.lower().split()).items():
            c = min(c, 3)
            n[y] += c
            for f in {w, *(w[:k] + "*" for k in range(3, 7) if len(w) >= k)}:
                by[y][f] += c
    a0, weights = 0.05 * sum(n), {}
    for f, y1 in by[1].items():
        y0 = by[0][f]
        if y1 < 3 or y1 * 4 <= y0:
            continue
        a = 0.05 * (y1 + y0)
        delta = math.log((y1 + a) / (n[1] + a0 - y1 - a)) - math.log((y0 + a) / (n[0] + a0 - y0 - a))
        w = delta - toxicity.Z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) - toxicity.OFFSET
        if w > toxicity.LEAST_WEIGHT:
            weights[f] = (w, (y0 + a) / (n[0] + a0))
    assert set(model.weights) == set(weights) and all(abs(model.weights[f] - w) < 1e-9 for f, (w, _) in weights.items())
    whole = {f: x for f, x in weights.items() if not f.endswith("*")}
    rest = 1 - sum(p for _, p in whole.values())
    assert abs(sum(p * math.exp(model.lam * w) for w, p in whole.values()) + rest * math.exp(-model.lam * toxicity.DRIFT) - 1) < 1e-6
    for i, text, _ in docs[:40]:
        words = text.lower().split()
        scores = [max([weights[f][0] for f in (w, *(w[:k] + "*" for k in range(3, 7) if len(w) >= k)) if f in weights], default=-toxicity.DRIFT) for w in words]
        excess = sum(max(0.0, model.lam * s - math.log(model.k * len(words))) for *_, s in brute_segments(scores))
        want = 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(excess))))
        found = toxicity.Scanner(model).scan(text)
        assert abs(model.score(model.excess(found[1], found[0])) - want) < 1e-6


def test_repeated_rows_count_but_are_not_collected(spark):
    docs, labels = toxic_corpus(60)
    d = spark.createDataFrame(docs * 4, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.fit(d, l, max_train=60, max_features=None, least_count=1, repeats=None).weights


# -- html -------------------------------------------------------------------------------------------


W = htmltext.Weights(tags={"p": -0.5, "b": -0.1, "br": -0.2, "h1": -0.5, "span": -0.2, "a": -1.0})


def test_best_region_matches_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        xs = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(0, 12))]
        best = max([0.0, *(sum(xs[a:b]) for a in range(len(xs)) for b in range(a + 1, len(xs) + 1))])
        a, b = htmltext.best_region(xs)
        assert abs(sum(xs[a:b]) - best) < 1e-9


def test_pages():
    page = """<html><head><title>T</title><style>x{}</style></head><body><nav><a href=/>Menu item</a></nav><header>Site name</header>
    <div class="cookie-notice">We use cookies and more words to be long enough</div>
    <article><h1>Title &amp; more</h1><p>First   paragraph\nwith <b>bold</b> text.<p>Second &#233;t&eacute;<br>line.
    <aside>Side note words</aside><div class="ad">Buy this now</div><form>Name <input></form><script>var a="<p>no</p>";</script></p>
    <section id="comments"><p>Reader says lol</p></section></article><footer>Copyright</footer></body></html>"""
    assert htmltext.extract(page, W) == "Title & more\nFirst paragraph with bold text.\nSecond été line."
    assert htmltext.extract(None, W) == htmltext.extract("", W) == htmltext.extract("<p></p>", W) == ""
    assert htmltext.extract("just words without tags", W) == "just words without tags"
    assert htmltext.extract("<div><p>one two three<p>four five<!-- no --></div>", W) == "one two three\nfour five"


def test_layout_classes_and_sibling_articles():
    for attrs in ('class="layout has-sidebar"', 'id="wrap" class="with-comments"'):
        assert htmltext.extract(f"<div {attrs}><article><p>one two three four</p></article></div>", W) == "one two three four"
    for c in ("entry-header", "post-header"):
        assert htmltext.extract(f'<article><div class="{c}"><h1>Head line</h1></div><p>one two three four</p></article>', W) == "Head line\none two three four"
    two = "<p>" + "word " * 40 + "</p>"
    assert len(htmltext.extract(f"<div><article>{two}</article><article>{two}</article></div>", W).split()) == 80
    assert htmltext.extract('<article><p>one two three</p><div class="sidebar">no no</div><div class="post-comments">no no</div></article>', W) == "one two three"


def test_extraction_table(spark):
    rows = [(1, "u", "<article><p>hello world again</p></article>", 5), (2, None, None, 6), (2, None, None, 6), (3, "v", "<article>" + "<p>word word</p>" * 20_000 + "</article>", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.extracted(df, htmltext.fit(df)).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 17), (2, 0), (2, 0), (3, 20_000 * 10 - 1)]
    assert htmltext.extracted(df.limit(0), W).count() == 0


# -- quality ----------------------------------------------------------------------------------------


def test_quality_held_out_and_shrinkage(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        text = " ".join(words) + "." if good else "SPAM!! " * 30 + "###"
        docs.append((i, text, f"h{i % 5}" if i else None, "en", 0))
        if i % 2:
            labels.append((i, int(good), 0))
    docs += [(900, None, "rare", None, 0), (901, "", "rare", "de", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score int")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in quality.classified(d, l, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(got) == 402 and sum(got[i]["predicted"] == int(i % 3 > 0) for i in range(0, 400, 2)) >= 195
    assert all(0 <= r["score"] <= 1 for r in got.values())
    spread = [r["host_posterior"] for r in got.values()]
    assert max(spread) - min(spread) < 0.5
    assert quality.classified(d.limit(0), l, F.col("source"), F.col("lang")).count() == 0
    assert {r["predicted"] for r in quality.classified(d.limit(9), l.limit(0), F.col("source"), F.col("lang")).collect()} == {1}


def test_posteriors_against_plain_sums(spark):
    import math

    from pyspark.sql import functions as F

    rng = random.Random(16)
    docs = [(i if i % 9 else None, " ".join(rng.choice(["alpha", "beta!!", "###", "Gamma."]) for _ in range(rng.randrange(1, 30))), rng.choice(["a", "b", "", None]), rng.choice(["en", "de", None])) for i in range(200)]
    docs += docs[:5]  # repeated rows
    labels = [(i, rng.randrange(2), 0) for i in range(0, 200, 3)]
    d = spark.createDataFrame([(*r, 1.5, "x") for r in docs], "doc_id long, text string, source string, lang string, s double, prior string").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classified(d, l, F.col("source"), F.col("lang")).collect()
    known = {i: y for i, y, _ in labels}
    rows = [(r["host"], r["path"], r["document"], known.get(r["doc_id"], r["document"])) for r in got]
    prior = (sum(v for *_, v in rows) + 1) / (len(rows) + 2)

    def site(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[3]
        return out

    def strength(sites, prior_of):
        within = [prior_of(k) * (1 - prior_of(k)) for k in sites]
        total = sum(n for n, _ in sites.values())
        spread = sum(n * (s / n - prior_of(k)) ** 2 for k, (n, s) in sites.items()) - sum(within)
        between = spread / max(total - sum(n * n for n, _ in sites.values()) / total, 1e-9)
        return min(1e9, sum(within) / len(within) / max(between, 1e-9))

    hosts, paths = site(lambda r: r[0]), site(lambda r: r[:2])
    kh = strength(hosts, lambda _: prior)
    kp = strength(paths, lambda k: (hosts[k[0]][1] + kh * prior) / (hosts[k[0]][0] + kh))
    assert len(got) == len(docs) and len({r["host"] for r in got}) == 4
    for r, (host, path, p, value) in zip(got, rows, strict=True):
        hp = (hosts[host][1] - (value - p) + kh * prior) / (hosts[host][0] + kh)
        pp = (paths[host, path][1] - (value - p) + kp * hp) / (paths[host, path][0] + kp)
        total = math.log(p / (1 - p)) + math.log(pp / (1 - pp)) - math.log(prior / (1 - prior))
        assert abs(r["host_posterior"] - hp) < 1e-9 and abs(r["path_posterior"] - pp) < 1e-9 and abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_quality_held_out_on_the_given_table(spark):
    import os

    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no table")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = quality.classified(docs, labels.where(~held), F.col("source"), F.col("lang"))
    right = scored.join(labels.where(held), "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    print("held out:", right)
    assert right >= 0.95


# -- chat -------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    import json

    call = json.dumps({"content": None, "tool_calls": [{"id": "a", "name": "search", "arguments": '{"query": "é", "limit": 3}'}, {"id": "b", "name": "lookup", "arguments": {"id": "x"}, "after": ["a"]}, {"id": "c", "name": "nope", "arguments": {}, "after": ["c"]}]})
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", call, 9), (1, 0, "tool", json.dumps({"tool_call_id": "a", "content": [1, 2]}), 9), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "x"}), 9), (2, 0, None, None, 9), (2, 0, None, None, 9), (3, 0, "user", "{not json", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    got = chat.formatted(df).collect()
    assert len(got) == len(rows) + 3
    calls = {r["ident"]: r for r in got if r["kind"] == "call"}
    assert calls["a"]["problems"] == [] and json.loads(calls["a"]["json"])["arguments"] == {"query": "é", "limit": 3}
    assert "$.id: not integer" in calls["b"]["problems"] and calls["b"]["level"] == 1
    assert "name: unknown tool nope" in calls["c"]["problems"] and "cycle" in calls["c"]["problems"]
    result = next(r for r in got if r["ident"] == "a" and r["kind"] == "message")
    assert (result["order_turn"], result["level"]) == (1, 1) and json.loads(result["json"])["content"] == "[1,2]"
    assert next(r for r in got if r["ident"] == "zz")["problems"] == ["result without call"]
    assert all(r["json"] == chat.canonical(json.loads(r["json"])) for r in got)
    assert chat.formatted(df.limit(0)).count() == 0


def test_long_chain_of_calls(spark):
    import json

    calls = [{"id": f"k{i}", "name": "search", "arguments": {"query": "x"}, "after": [f"k{i - 1}"] if i else []} for i in range(500)]
    calls += [{"id": "p", "name": "search", "arguments": {"query": "x"}, "after": ["q"]}, {"id": "q", "name": "search", "arguments": {"query": "x"}, "after": ["p"]}, {"id": "r", "name": "search", "arguments": {"query": "x"}, "after": ["q", "k3"]}]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn long, role string, text string")
    got = {r["ident"]: r for r in chat.formatted(df).collect() if r["kind"] == "call"}
    assert [got[f"k{i}"]["level"] for i in range(500)] == list(range(500))
    assert {i for i, r in got.items() if "cycle" in r["problems"]} == {"p", "q", "r"}


# -- images -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [None, 31])
def test_copies_are_found_and_recall(spark, width):
    rng = np.random.default_rng(0)
    base = [images.picture(rng.normal(size=64), 96) for _ in range(30)]
    rows = [(20 * i, images.encode(p)) for i, p in enumerate(base)]
    want = {}
    for i, p in enumerate(base[:24]):
        edit = [p[8:90, 6:92], p * 0.8 + 20, p + rng.normal(0, 4, p.shape), p.T[::-1]][i % 4]
        rows.append((1001 + i, images.encode(edit)))
        want[20 * i] = 1001 + i
    rows += [(5000, None), (5001, b"xx"), (5002, images.encode(np.full((50, 50), 7.0))), (5003, images.encode(base[0])), (5004, images.encode(base[0]))]
    df = spark.createDataFrame(rows, "id long, image binary")
    got = {r["id"]: r for r in images.copies(df, width=width).collect()}
    assert len(got) == len(rows)
    hits = sum(w in (got[q]["matches"] or []) for q, w in want.items())
    assert hits >= 0.9 * len(want)
    assert got[5003]["class_id"] == got[5004]["class_id"] == 0
    wrong = sum(len([m for m in r["matches"] if m != want.get(q)]) for q, r in got.items() if q in want and r["matches"])
    assert wrong <= 2
    assert images.copies(df.limit(0)).count() == 0


def test_tables_find_as_many_points_at_any_width():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    noisy = np.packbits(np.unpackbits(bits, axis=1) ^ (rng.random((2000, 256)) < 0.1), axis=1)
    for width in (16, 31, 40):
        tables = images.bit_tables(width)
        assert (images.table_keys(bits, tables) == images.table_keys(noisy, tables)).any(axis=1).mean() >= images.FOUND - 0.03


def brute_copies(a, b):
    """Whether matching all descriptors of two images gives a consensus."""
    x, y = (np.unpackbits(np.array([np.frombuffer(p[4], np.uint8) for p in d]), axis=1).astype(np.int32) for d in (a, b))
    i, j = np.nonzero(x @ (1 - y).T + (1 - x) @ y.T < images.NEAR)
    if not len(i):
        return False
    return images.consensus(*np.array([a[k][:4] for k in i]).T, *np.array([b[k][:4] for k in j]).T) >= images.CONSENSUS


@pytest.mark.parametrize("width", [16, 31, 40])
def test_recall_of_each_edit_against_brute_force(spark, width):
    """Crops, halves, resized by 0.75 and 1.25, dimmed, noisy and turned pictures, at the widths that tables of any size use."""
    rng = np.random.default_rng(11)
    rows, want, brute = [], {}, {}
    for i in range(8 * images.EDITS):
        p = images.picture(rng.normal(size=64) / 8)
        e = images.edited(p, 2 * i)
        rows += [(1001 + 20 * i, images.encode(p)), (20 * i, images.encode(e))]
        want[20 * i] = 1001 + 20 * i
        brute[20 * i] = brute_copies(images.describe(images.decode(rows[-1][1])), images.describe(images.decode(rows[-2][1])))
    got = {r["id"]: r["matches"] for r in images.copies(spark.createDataFrame(rows, "id long, image binary"), width=width).collect()}
    hits = {q: w in got[q] for q, w in want.items()}
    for kind in range(images.EDITS):
        mine = [q for q in want if q // 20 % images.EDITS == kind]
        print(width, kind, sum(brute[q] for q in mine), sum(hits[q] for q in mine), len(mine))
        assert sum(hits[q] for q in mine) >= 0.9 * sum(brute[q] for q in mine) - 0.3
    assert sum(hits.values()) >= 0.9 * len(want) and sum(brute.values()) >= 0.95 * len(want)
    assert sum(len(m) - (want[q] in m) for q, m in got.items() if q in want) <= 1


def test_chance_matches_of_points_stay_in_their_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(240)]
    df = images.drawn(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    cut, written = images.Scratch.cut, {}

    def counted(self, table, name):
        out = cut(self, table, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(images.Scratch, "cut", counted)
    whole = sorted(images.copies(df).collect())
    # only images and links are written, not points or pairs of points, whose number grows with the square of the table
    assert max(written.values()) <= df.count(), written
    assert sum(len(r["matches"] or []) for r in whole) >= 20
    for name, few in (("SLICE", 300), ("BLOCK", 2000), ("MATCHES", 40)):
        monkeypatch.setattr(images, name, few)
    assert sorted(images.copies(df).collect()) == whole


@pytest.mark.parametrize("batch", [7, 1 << 18])
def test_near_points_are_those_of_all_pairs(monkeypatch, batch):
    monkeypatch.setattr(images, "BATCH", batch)
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (60, 32), np.uint8)
    b = np.concatenate([a ^ np.packbits(rng.random((60, 256)) < 0.12, axis=1), rng.integers(0, 256, (40, 32), np.uint8), a[:5], np.zeros((2, 32), np.uint8)])
    a = np.concatenate([a, np.zeros((1, 32), np.uint8)])
    a_own, b_own, tables = np.arange(len(a)) // 4, np.arange(len(b)) % 9, images.bit_tables(20)
    ones = images.table_keys(a, tables), images.table_keys(b, tables)
    want = [
        i * len(b) + j
        for i in range(len(a))
        for j in range(len(b))
        if a_own[i] != b_own[j] and np.bitwise_count(a[i] ^ b[j]).sum() < images.NEAR and any(x == y and 3 <= int(x).bit_count() <= 17 for x, y in zip(ones[0][i], ones[1][j], strict=True))
    ]
    assert images.near_points(a, b, a_own, b_own, tables, images.NEAR, 3).tolist() == want and len(want) > 20
    assert images.near_points(a, b, a_own, b_own, tables, images.NEAR, 3, most=10) is None


def test_an_image_is_described_as_alone():
    rng = np.random.default_rng(5)
    imgs = [images.decode(images.encode(images.edited(images.picture(rng.normal(size=64)), i))) for i in range(30)] + [None, np.zeros((80, 80), np.float32)]
    for img, (places, bits) in zip(imgs, images.describe_all(imgs), strict=True):
        alone = images.describe(img)
        assert [p[:4] for p in alone] == list(map(tuple, places.tolist())) and [p[4] for p in alone] == list(map(bytes, bits))


def test_small_crops_of_large_images_and_odd_rasters(spark):
    rng = np.random.default_rng(3)
    base = [images.picture(rng.normal(size=64), 288) for _ in range(16)]
    rows, want = [], {}
    for i, p in enumerate(base):  # small crops of large images, as queries
        y, x = rng.integers(0, 288 - 84, 2)
        rows += [(20 * i, images.encode(p[y : y + 84, x : x + 84])), (1001 + 20 * i, images.encode(p))]
        want[20 * i] = 1001 + 20 * i
    rows += [(7, images.encode(rng.uniform(0, 255, (1, 500)))), (7, images.encode(rng.uniform(0, 255, (500, 1)))), (8, images.encode(np.zeros((0, 0)))), (-20, images.encode(base[0])), (None, images.encode(base[1]))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, image binary, class int, sha string")
    got = images.copies(df, width=40).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(rows) and sum(w in by[q]["matches"] or -20 in by[q]["matches"] for q, w in want.items()) >= 0.9 * len(want)
    assert by[1001]["class_id"] == by[-20]["class_id"] == -20 and by[7]["n_points"] == by[8]["n_points"] == 0


def test_drawn_table_holds_edited_copies(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(400)] + [(None, None)], "vec_id long, embedding array<float>")
    got = {r["id"]: r["matches"] for r in images.copies(images.drawn(df)).collect()}
    assert len(got) == 441 and sum(i is not None and i < 0 for i in got) == 40
    pairs = [(i, -10 - i) if i % 20 == 0 else (-10 - i, i) for i in range(0, 400, 10) if i % 200 != 100]
    assert sum(b in got[a] for a, b in pairs) >= 0.9 * len(pairs)
    assert {-110, -310} & set(got[0])
