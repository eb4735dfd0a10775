import json
import random
from collections import Counter, defaultdict

from lakeglean.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def call(ident, after=(), **more):
    return {"id": ident, "name": "search", "arguments": {"query": "x"}, "after": list(after)} | more


def test_legal_texts_that_are_hard_to_write(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = [
        '{"content": "a \\ud800 b", "tool_calls": [{"id": "\\udfff", "name": "search", "arguments": {"query": "\\ud83d\\ude00"}}]}',
        '{"tool_calls": [{"id": 7, "name": "lookup", "arguments": {"id": ' + "9" * 400 + "}}]}",
        '{"tool_calls": [{"id": {"b": 1, "a": 2}, "name": ["search"], "arguments": {}}]}',
        '{"tool_calls": [{"id": "n", "name": "lookup", "arguments": {"id": NaN}}]}',
        '{"tool_calls": [{"id": "s", "name": "lookup", "arguments": "{\\"id\\": Infinity}"}]}',
        '{"tool_calls": [{"id": "o", "name": "lookup", "arguments": {"id": 1e999}}]}',
        '{"tool_calls": [], "content": ' + deep + "}",
        '{"tool_calls": [{"id": "u", "name": "lookup", "arguments": {"\\ud800": 1, "id": 1}, "after": [null, 7]}]}',
        "{" + "9" * 6000,
        "x" * 3_000_000,
    ]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], SCHEMA)
    got = chat.formatted(df).collect()
    by = {r["ident"]: r for r in got if r["kind"] == "call"}
    assert set(by) == {"\\udfff", "7", '{"a":2,"b":1}', "s", "u"}
    assert by["7"]["problems"] == ["call without result"]
    assert "name: unknown tool [\"search\"]" in by['{"a":2,"b":1}']["problems"]
    assert "arguments: not JSON" in by["s"]["problems"] and "$.\\ud800: unknown" in by["u"]["problems"]
    strict = lambda x: (_ for _ in ()).throw(ValueError(x))
    for r in got:
        json.loads(r["json"], parse_constant=strict)
    plain = {r["turn"]: json.loads(r["json"])["content"] for r in got if r["kind"] == "message"}
    assert plain[0] == "a \ud800 b" and all(plain[i] == texts[i] for i in (3, 5, 6, 8, 9))


def test_null_turns_ids_and_repeats(spark):
    text = json.dumps({"tool_calls": [call("a"), call("b", ["a"]), call("b", ["a"])]})
    rows = [(None, None, "assistant", text), (4, None, "assistant", text), (4, None, "assistant", text), (4, 2, None, "")]
    got = chat.formatted(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", problems string")).collect()
    assert len(got) == 4 + 9 and all("repeated call id" in r["problems"] for r in got if r["conv_id"] == 4 and r["kind"] == "call")


def brute_places(turns, after):
    """(turn, level) by relaxing every dependency until nothing changes; None for what is on or behind a cycle."""
    free, place = set(), {x: (t, 0) for x, t in turns.items()}
    while more := [x for x in turns if x not in free and all(b in free for b in after[x])]:
        for x in more:
            place[x] = max([place[x], *((place[b][0], place[b][1] + 1) for b in after[x])])
        free |= set(more)
    return {x: place[x] if x in free else None for x in turns}


def test_order_matches_brute_force_gathered_and_peeled(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(12):
        names = [f"c{i}" for i in range(rng.randrange(1, 25))]
        turns = {x: rng.randrange(6) for x in names}
        after = {x: {b for b in rng.sample(names, min(len(names), rng.randrange(0, 4))) if conv % 3 == 0 or names.index(b) < i} for i, x in enumerate(names)}
        for turn in range(6):
            calls = [call(x, after[x]) for x in names if turns[x] == turn]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            rows += [(conv, rng.randrange(6), "tool", json.dumps({"tool_call_id": c["id"], "content": "r"})) for c in calls]
        want |= {(conv, x): p for x, p in brute_places(turns, after).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    once = chat.formatted(df).collect()
    for r in once:
        p = want.get((r["conv_id"], r["ident"]))
        if r["kind"] == "call":
            assert ("cycle" in r["problems"]) == (p is None)
        if p is not None:
            assert (r["order_turn"], r["level"]) == ((p[0], p[1]) if r["kind"] == "call" else (max(p[0], r["turn"]), p[1] + 1))
    some = [r for r in rows if r[0] < 2]
    peeled = chat.formatted(spark.createDataFrame(some, SCHEMA), gather=3).collect()
    acyclic = lambda rs: sorted(str(r) for r in rs if "cycle" not in r["problems"])
    assert acyclic(peeled) == acyclic(r for r in once if r["conv_id"] < 2)
    assert sorted((r["conv_id"], r["ident"]) for r in peeled if "cycle" in r["problems"]) == sorted((r["conv_id"], r["ident"]) for r in once if r["conv_id"] < 2 and "cycle" in r["problems"])


def test_null_conversations_link_like_any_other(spark):
    rows = [(turn, role, json.dumps(x)) for turn, role, x in [(0, "assistant", {"tool_calls": [call("a")]}), (1, "tool", {"tool_call_id": "a", "content": "r"}), (2, "assistant", {"tool_calls": [call("b", ["a"])]}), (3, "tool", {"tool_call_id": "b"})]]
    got = chat.formatted(spark.createDataFrame([(c, *r) for c in (None, 1) for r in rows], SCHEMA))
    by = defaultdict(list)
    for r in got.collect():
        by[r["conv_id"]].append((r["turn"], r["order_turn"], r["level"], r["kind"], r["ident"], r["json"], r["problems"]))
    assert sorted(by[None], key=str) == sorted(by[1], key=str) and len(by[1]) == 6
    assert all(p[-1] == [] for p in by[None]) and ("b", 1) in {(p[4], p[2]) for p in by[None]}
    few = chat.formatted(spark.createDataFrame([(None, *r) for r in rows], SCHEMA), gather=0).collect()
    assert sorted((r["turn"], r["level"], r["ident"] or "") for r in few) == sorted((p[0], p[2], p[4] or "") for p in by[None])


def plainly(rows):
    """Links, places and problems of drawn rows by dictionaries: (conv, turn, kind, ident, order_turn, level, problems)."""
    events, calls, results, behind = [], defaultdict(list), Counter(), defaultdict(lambda: defaultdict(set))
    for conv, turn, text in rows:
        value = json.loads(text) if text and text.startswith("{") else {}
        events.append((conv, turn, "message", value.get("tool_call_id"), []))
        if (i := value.get("tool_call_id")) is not None:
            results[conv, i] += 1
        for c in value.get("tool_calls", []):
            problems = []
            try:
                arguments = json.loads(c["arguments"])
            except ValueError:
                problems = ["arguments: not JSON"]
            else:
                if c["name"] == "fetch":
                    problems = ["name: unknown tool fetch"]
                elif c["name"] == "lookup" and "id" not in arguments:
                    problems = ["$.id: missing"]
                elif c["name"] == "search":
                    problems = [f"$.{k}: {x}" for k, x, bad in (("query", "missing", "query" not in arguments), ("limit", "not integer", "limit" in arguments)) if bad]
            i = c.get("id")
            events.append((conv, turn, "call", i, problems if i is not None else [*problems, "id: missing"]))
            if i is not None:
                calls[conv, i].append(turn)
                behind[conv][i] |= set(c["after"])
    place = {}
    for conv, after in behind.items():
        turns = {i: min(calls[conv, i]) for i in after}
        for i, p in brute_places(turns, {i: {b for b in bs if b in after} for i, bs in after.items()}).items():
            place[conv, i] = p
    out = []
    for conv, turn, kind, i, problems in events:
        key = (conv, i)
        p = place.get(key) if i is not None else None
        cyclic = i is not None and key in place and p is None
        notes = [n for n, on in (
            ("call without result", kind == "call" and not results[key]), ("result without call", kind == "message" and i is not None and key not in calls),
            ("repeated call id", i is not None and len(calls.get(key, ())) > 1), ("repeated result", i is not None and results[key] > 1), ("cycle", cyclic)) if on]
        level = None if cyclic else (p[1] if p else 0) + (kind == "message" and i is not None)
        out.append((conv, turn, kind, i, None if cyclic else max(turn, p[0] if p else turn), level, [*problems, *notes]))
    return out


def test_drawn_calls_link_as_plain_dictionaries_say(spark):
    rng = random.Random(8)
    rows = [(c if c < 148 else None, t, ("user", "assistant")[t % 2], rng.choice(["plain", 'a "quoted"\nline', "", None, "ça"])) for c in range(149) for t in range(rng.randrange(1, 14))]
    rows += [(7, 3, "assistant", json.dumps({"tool_calls": []})), (7, 4, None, "x"), (7, 0, "system", "s")]
    table = chat.drawn(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", h int")).cache()
    drawn = [(r["conv_id"], r["turn"], r["text"]) for r in table.collect()]
    want = plainly(drawn)
    got = [(r["conv_id"], r["turn"], r["kind"], r["ident"], *((None, None) if "cycle" in r["problems"] else (r["order_turn"], r["level"])), r["problems"]) for r in chat.formatted(table).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))
    kinds = {p for r in want for p in r[-1]}
    assert kinds >= {"call without result", "result without call", "repeated call id", "repeated result", "cycle", "id: missing", "arguments: not JSON", "name: unknown tool fetch", "$.limit: not integer", "$.id: missing"}
    # every message is there once, with its own content
    content = Counter((c, t, json.loads(x).get("content") if x and x.startswith("{") else x) for c, t, x in drawn if not (x or "").startswith('{"tool_call_id"'))
    assert content == Counter((c, t, None if x and x.startswith("{") else x) for c, t, _, x in rows)
