"""Keyed tables: what a change rewrites, what readers see, what a repeated or broken change does. Trails on hubs."""

import pytest
from pyspark.sql import functions as F

from quillmine.operators import graph
from quillmine.sources.keyed import ConflictError, KeyedTable

SCHEMA = "workspace string, id long, value string"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    t = KeyedTable(spark, f"file://{tmp_path}/t", schema, ["workspace", "id"], buckets=8)
    t.upsert(rows(spark, [("a", i, f"v{i}") for i in range(200)] + [(None, 7, "n"), ("b", None, "m")]), "first")
    return t


def rows(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def have(t, version=None):
    return sorted(map(tuple, t.rows(version).collect()), key=repr)


def test_upsert_of_one_key_rewrites_one_bucket(spark, table):
    before = table._folders(table.version())
    assert len(before) == 8 and have(table) == sorted([("a", i, f"v{i}") for i in range(200)] + [(None, 7, "n"), ("b", None, "m")], key=repr)
    assert table.upsert(rows(spark, [("a", 5, "new")]), "second") == 2
    after = table._folders(2)
    assert sum(before[b] != after[b] for b in before) == 1
    assert [r["value"] for r in table.get("a", 5).collect()] == ["new"] and table.rows().count() == 202
    assert len(table.get("a", 6).inputFiles()) == 1
    assert [r["value"] for r in table.rows(1).where("id = 5").collect()] == ["v5"]  # older versions stay readable


def test_null_keys_are_keys(spark, table):
    table.upsert(rows(spark, [(None, 7, "n2"), ("b", None, "m2"), ("b", 7, "x")]), "nulls")
    assert [r["value"] for r in table.get(None, 7).collect()] == ["n2"] and [r["value"] for r in table.get("b", None).collect()] == ["m2"]
    assert table.rows().count() == 203


def test_a_batch_counts_once(spark, table):
    add = lambda old, new: old.unionByName(new)
    assert table.upsert(rows(spark, [("a", 5, "again")]), "add", add) == 2 == table.upsert(rows(spark, [("a", 5, "again")]), "add", add)
    assert table.get("a", 5).count() == 2 and table.version() == 2


def test_deletes(spark, table):
    before = table._folders(1)
    table.delete(spark.createDataFrame([("a", 5), (None, 7), ("zz", 1)], "workspace string, id long"), "some")
    assert table.rows().count() == 200 and table.get("a", 5).count() == 0
    changed = [b for b in before if before[b] != table._folders(2).get(b)]
    assert 1 <= len(changed) <= 3
    assert table.delete_where("id < 100", "half") == 3 and table.rows().count() == 101  # the null id stays
    assert table.delete_where("id < 100", "none left") == 4 and table.rows().count() == 101
    table.delete_where("true", "all")
    assert have(table) == [] and table.version() == 5 and len(have(table, 3)) == 101
    table.upsert(rows(spark, [("a", 1, "back")]), "back")
    assert have(table) == [("a", 1, "back")]


def test_a_change_that_dies_leaves_nothing(spark, table, monkeypatch):
    new = rows(spark, [("a", 5, "x"), ("a", 500, "y")])
    with monkeypatch.context() as m:  # it dies with its rows written, before the manifest
        m.setattr(KeyedTable, "_folders", lambda self, version, f=KeyedTable._folders: f(self, version))
        seen = iter([1, 2])
        m.setattr(KeyedTable, "version", lambda self: next(seen))
        with pytest.raises(ConflictError):
            table.upsert(new, "dies")
    assert table.version() == 1 and table.rows().count() == 202 and table.get("a", 500).count() == 0
    assert table.upsert(new, "dies") == 2 and table.rows().count() == 203


def test_hot_bucket_is_dealt_out(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/hot", spark.createDataFrame([], SCHEMA).schema, ["workspace"], buckets=4)
    t.upsert(spark.range(30_000).select(F.lit("one").alias("workspace"), "id", F.repeat(F.lit("x"), 20).alias("value")), "b")
    assert t.get("one").count() == 30_000 and len(t._folders(1)) == 1


RELATIONS = "id long, source_entity_id long, target_entity_id long, paper_id long"


def test_trails_across_a_hub(spark):
    """1 and 2 each meet 50,000 nodes that all meet the hub 3: 2.5 thousand million trails of four relations from 1 to 2."""
    n = 50_000
    side = lambda end, first: [
        spark.range(n).select((F.col("id") + first).alias("id"), F.lit(end).cast("long").alias("source_entity_id"), (F.col("id") + first + 10).alias("target_entity_id"), F.lit(1).cast("long").alias("paper_id")),
        spark.range(n).select((F.col("id") + first + n).alias("id"), (F.col("id") + first + 10).alias("source_entity_id"), F.lit(3).cast("long").alias("target_entity_id"), F.lit(1).cast("long").alias("paper_id")),
    ]
    parts = [*side(1, 0), *side(2, 10 * n)]
    r = parts[0]
    for p in parts[1:]:
        r = r.unionByName(p)
    got = [(x["hops"], x["edges"]) for x in graph.paths_between(r, [1], [2], 4, 20).collect()]
    assert got == [(4, [0, n, 11 * n + i, 10 * n + i]) for i in range(20)]
    near = sorted(x["id"] for x in graph.neighbourhood(r, [3], 2, 100).collect())
    assert near == list(range(n, n + 100))


def test_least_trails_that_lead_nowhere(spark):
    """The least thousand beginnings end in a blind alley that only looks open, as its relation would be used twice."""
    blind = [(i, 1, 100 + i, 0) for i in range(1000)] + [(1000 + i, 100 + i, 2, 0) for i in range(1000)]
    rel = [*blind, (5000, 1, 7, 0), (5001, 7, 8, 0), (5002, 8, 9, 0), (5003, 9, 3, 0), (5004, 2, 2, 0)]
    r = spark.createDataFrame(rel, RELATIONS)
    assert [x["edges"] for x in graph.paths_between(r, [1], [3], 4, 5).collect()] == [[5000, 5001, 5002, 5003]]
    loop = spark.createDataFrame([*((i, 1, 2, 0) for i in range(700)), (900, 2, 3, 0)], RELATIONS)
    got = graph.paths_between(loop, [1], [3], 4, 3).collect()
    assert [x["edges"] for x in got] == [[0, 900], [1, 900], [2, 900]]
