import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from lakeglean.llm import repair


def best_edits(rows):
    """Least (cost, audit, roles) over every choice of edits and up to three insertions in each gap; rows are (letter, forced, cut)."""
    found = None
    choices = [[("D", 3, "")] + ([] if forced else [("K", cut, letter)] + [("R", 2 + cut, x) for x in "ua" if x != letter]) for letter, forced, cut in rows]
    gaps = [[]] + [list(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, ins))
            if found and cost > found[0]:
                continue
            audit, roles = "", ""
            for i, gap in enumerate(ins):
                audit += "I" * len(gap) + (edits[i][0] if i < len(edits) else "")
                roles += "".join(gap) + (edits[i][2] if i < len(edits) else "")
            if re.fullmatch("(s?(ua)+)?", roles) and (found is None or (cost, audit) < found[:2]):
                found = (cost, audit, roles)
    return found


def letters(rows):
    return tuple(("d", 1) if forced else (letter.upper() if cut else letter, 1) for letter, forced, cut in rows)


def test_parse_is_the_cheapest_repair():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        out = repair.parse(letters(rows), 0)
        assert min(v for v in (out[0], out[3]) if v) == best_edits(rows)[:2], rows


def test_segments_chain_to_the_whole_parse():
    rng = random.Random(6)
    for _ in range(300):
        rows = letters([(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 14))])
        whole = repair.parse(rows, 0)
        cut = rng.randrange(len(rows) + 1)
        at = [(0, ""), None, None, None]
        for part in (rows[:cut], rows[cut:]):
            at = repair.chained(at, [repair.parse(part, p) for p in range(4)])
        ends = lambda x: min(v for v in (x[0], x[3]) if v is not None)
        assert ends(at) == ends(whole)
    assert repair.parse((("d", 5),), 0)[0] == (15, "DDDDD")


def plain(rows):
    """{conv_id: the contract's columns} from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault:
                text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                after += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in after:
            core = text.strip(" \t\n\x0b\f\r")
            kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        # least (cost, audit, text) of each place, row by row
        at = {"": (0, "", ())}

        def grow(at):
            for _ in range(3):
                for place, (c, a, t) in list(at.items()):
                    to = "a" if place == "u" else "u"
                    new = (c + 2, a + "I", (*t, ("user" if to == "u" else "assistant") + ":"))
                    at[to] = min(at.get(to, new), new, key=lambda v: v[:2])
            return at

        at = grow(at)
        for (_, role, text), kind in zip(after, kinds, strict=True):
            nxt = {}

            def offer(place, v):
                nxt[place] = min(nxt.get(place, v), v, key=lambda x: x[:2])

            for place, (c, a, t) in at.items():
                offer(place, (c + 3, a + "D", t))
                if kind in ("blank", "duplicate"):
                    continue
                extra = kind == "truncated"
                to = "a" if place == "u" else "u"
                if role[:1] == to:
                    offer(to, (c + extra, a + "K", (*t, f"{role}:{text}")))
                else:
                    offer(to, (c + 2 + extra, a + "R", (*t, f"{'user' if to == 'u' else 'assistant'}:{text}")))
                if place == "" and role[:1] == "s":
                    offer("s", (c + extra, a + "K", (*t, f"{role}:{text}")))
            at = grow(nxt)
        cost, audit, texts = min((at[p] for p in ("", "a") if p in at), key=lambda v: v[:2])
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def some(n, seed=1):
    rng = random.Random(seed)
    texts = ["hello.", "yes!", "no", "", None, " \n", "why?", "a.b", "é 漢.", "ok. \x85"]
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ua", "s"]), rng.choice([*texts, f"text {rng.randrange(99)}."])) for _ in range(n)]


DDL = "conv_id long, turn long, role string, text string, rows string"


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_structure_against_a_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = some(700) + [(3, 3, "user", "again and again.")] * 50 + [(7, t, "user", "one text.") for t in range(60)] + [(8, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(200)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.structure(spark.createDataFrame([(*r, "x") for r in rows], DDL)).collect()}
    assert got == plain(rows)


def test_structure_against_sql(spark):
    rows = some(600, seed=2)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = repair.structure(spark.createDataFrame([(*r, "x") for r in rows], DDL))
    frame = con.sql(repair.ORACLE)
    assert sorted(map(repr, map(tuple, got.select(*frame.columns).collect()))) == sorted(map(repr, frame.fetchall()))


def test_empty_table_and_a_conversation_without_rows(spark):
    assert repair.structure(spark.createDataFrame([], DDL)).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.structure(spark.createDataFrame([(lost, 0, "user", "gone.", "")], DDL)).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
