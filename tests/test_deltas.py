"""Aggregates kept by changes against those of all rows."""

import random

import pytest

from quillmine.operators.deltas import Maintained

SCHEMA = "g string, h int, v long, sign int"


def recomputed(rows):
    out = {}
    for g, h, v in rows:
        out.setdefault((g, h), []).append(v)
    some = lambda vs: [v for v in vs if v is not None]
    return sorted(((g, h, len(vs), sum(some(vs)), min(some(vs), default=None), max(some(vs), default=None)) for (g, h), vs in out.items()), key=repr)


def have(m):
    return sorted((tuple(r[c] for c in ("g", "h", "n", "total", "low", "high")) for r in m.rows().collect()), key=repr)


def test_random_changes(spark, tmp_path):
    rng = random.Random(1)
    m = Maintained.empty(spark, f"file://{tmp_path}/m", {"g": "string", "h": "int"}, "v", buckets=4)
    rows = []
    assert have(m) == []
    for step in range(5):
        new = [(rng.choice("abcdef") if rng.random() < 0.95 else None, rng.randrange(3), rng.choice([None, *range(-4, 5)])) for _ in range(40)]
        old = rng.sample(rows, min(len(rows), 35)) if step < 4 else list(rows)  # at last all that were there go
        changes = [(*r, 1) for r in new] + [(*r, -1) for r in old]
        for r in old:
            rows.remove(r)
        rows += new
        rng.shuffle(changes)
        m.apply(spark.createDataFrame(changes, SCHEMA), f"step {step}")
        if step == 2:
            m.apply(spark.createDataFrame(changes, SCHEMA), f"step {step}")  # once more
        assert have(m) == recomputed(rows)


def test_only_touched_groups_are_read(spark, tmp_path):
    m = Maintained.empty(spark, f"file://{tmp_path}/m", {"g": "string", "h": "int"}, "v", buckets=8)
    m.apply(spark.createDataFrame([(f"g{i}", 0, v, 1) for i in range(40) for v in (1, 5, 9)], SCHEMA), "load")
    before = (m.base._folders(1), m.totals._folders(1))
    m.apply(spark.createDataFrame([("g7", 0, 9, -1), ("g7", 0, 1, -1)], SCHEMA), "less")
    after = (m.base._folders(2), m.totals._folders(2))
    assert [sum(a[b] != c[b] for b in a) for a, c in zip(before, after, strict=True)] == [1, 1]
    assert [tuple(r) for r in m.totals.get("g7", 0).collect()] == [("g7", 0, 1, 5, 5, 5)]


def test_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    m = Maintained.empty(spark, f"file://{tmp_path}/m", {"g": "string", "h": "int"}, "v", buckets=2)
    changes = spark.createDataFrame([("a", 1, 3, 1), ("a", 1, 4, 1), ("b", 1, 0, 1)], SCHEMA)
    with monkeypatch.context() as c:
        c.setattr(m.totals, "upsert", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            m.apply(changes, "one")
    assert have(m) == [] and m.base.rows().count() == 3
    m.apply(changes, "one")
    assert have(m) == [("a", 1, 2, 7, 3, 4), ("b", 1, 1, 0, 0, 0)]


def test_a_row_that_is_not_there(spark, tmp_path):
    m = Maintained.empty(spark, f"file://{tmp_path}/m", {"g": "string", "h": "int"}, "v")
    with pytest.raises(Exception, match="not there"):
        m.apply(spark.createDataFrame([("a", 1, 3, -1)], SCHEMA), "wrong")
    assert have(m) == []
