import threading

import pytest
from lakeglean.operators import models as L
from lakeglean.sources import store
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select(F.col("id").alias("ID"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("bigint").alias("y")).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return L.forest(["a", "b"], trees=3, depth=3, leaf=1).fit(rows), L.logistic(["b"]).fit(rows)


def test_versions_are_numbered_and_load_as_registered(spark, rows, fitted, tmp_path):
    s = store.ModelStore(spark, f"file://{tmp_path}")
    assert s.versions("risk").count() == 0
    one, two = s.register("risk", fitted[0], {"run": 7}), s.register("risk", fitted[1])
    assert (one.version, two.version) == (1, 2) and one.inputs == ["a", "b"] and one.tags == {"run": "7"}
    assert [(r["version"], r["stages"][-1], r["inputs"]) for r in s.versions("risk").collect()] == [(1, "RandomForestClassificationModel", ["a", "b"]), (2, "LogisticRegressionModel", ["b"])]
    scores = [{r["ID"]: r["s"] for r in L.positive(m, rows).collect()} for m in (fitted[0], s.load("risk", 1, "RandomForestClassificationModel", ["a", "b"]))]
    assert scores[0] == scores[1]
    with pytest.raises(store.StoreError, match=r"no version 3; there are \[1, 2\]"):
        s.load("risk", 3)
    with pytest.raises(store.StoreError, match="ends in LogisticRegressionModel"):
        s.load("risk", 2, "RandomForestClassificationModel")
    with pytest.raises(store.StoreError, match="reads"):
        s.load("risk", 1, inputs=["b", "a"])
    with pytest.raises(store.StoreError, match="no name"):
        s.register("../risk", fitted[0])


def test_an_alias_moves_only_from_where_it_is(spark, fitted, tmp_path):
    s = store.ModelStore(spark, f"file://{tmp_path}")
    for _ in range(2):
        s.register("risk", fitted[1])
    with pytest.raises(store.StoreError, match="no alias"):
        s.load("risk", "live")
    s.promote("risk", "live", 1, expected=None)
    with pytest.raises(store.Conflict):
        s.promote("risk", "live", 2, expected=None)
    with pytest.raises(store.StoreError, match="no version 9"):
        s.promote("risk", "live", 9, expected=1)
    s.promote("risk", "live", 2, expected=1)
    s.promote("risk", "live", 1, expected=2)  # back again
    assert s.resolve("risk", "live") == 1
    assert [tuple(r) for r in s.history("risk", "live").collect()] == [(1, 1, None), (2, 2, 1), (3, 1, 2)]


def test_two_writers_never_both_win(spark, fitted, tmp_path, monkeypatch):
    s = store.ModelStore(spark, f"file://{tmp_path}")
    for _ in range(2):
        s.register("risk", fitted[1])
    s.promote("risk", "live", 1, expected=None)
    for n in range(4):
        at = s.resolve("risk", "live")
        gate = threading.Barrier(6)
        head, won = s._head, []

        def same_head(name, alias, head=head, gate=gate):
            found = head(name, alias)
            gate.wait()  # all have read before any writes
            return found

        monkeypatch.setattr(s, "_head", same_head)

        def move(k, won=won, at=at):
            try:
                s.promote("risk", "live", k % 2 + 1, expected=at)
                won.append(k % 2 + 1)
            except store.Conflict:
                pass

        threads = [threading.Thread(target=move, args=(k,)) for k in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        monkeypatch.undo()
        assert len(won) == 1 and s.resolve("risk", "live") == won[0]
        assert s.history("risk", "live").count() == n + 2


def test_overtaken_registrations_take_the_next_number(spark, fitted, tmp_path):
    s = store.ModelStore(spark, f"file://{tmp_path}")
    got = []
    threads = [threading.Thread(target=lambda: got.append(s.register("risk", fitted[1]).version)) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3, 4, 5] and s.versions("risk").count() == 5


def test_published_files_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x/00000001.json"
    assert store.publish(spark, path, "one") and not store.publish(spark, path, "two")
    assert (tmp_path / "x" / "00000001.json").read_text() == "one"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["00000001.json"]
