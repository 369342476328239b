"""Indexes against scans, on rows with every kind of key."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmine.functions.scores import bm25, tokens
from quillmine.operators import ann, graph, impact, postings, retrieve
from quillmine.plans import corpus as co

VECTORS = "paper_id long, workspace_id string, section string, embedding array<float>"


def vector_rows(n=900, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, dims))
    rows = []
    for i in range(n):
        x = middles[i % 20] + rng.normal(size=dims) * 0.5
        rows.append((i, "ab"[i % 3 == 0], f"s{i % 4}", [float(c) for c in np.float32(x / np.linalg.norm(x))]))
    rows += [(n + i, "a", "s1", rows[8][3]) for i in range(60)]  # copies: ties
    rows += [(5000, "a", "s1", None), (5001, "a", "s1", [1.0]), (5002, "a", "s1", [float("nan")] * dims), (5003, None, "s1", rows[0][3]), (5004, "lone", "s1", rows[0][3]), (5005, "a", "s1", [0.0] * dims), (5006, "a", None, [9.0] * dims)]
    return rows


def brute(rows, sources, n, section=None, exclude=()):
    ok = [(i, w, s, np.array(e, dtype=np.float64)) for i, w, s, e in rows if e is not None and len(e) > 1 and np.isfinite(e).all()]
    out = []
    for i, w, _, e in ok:
        if i in sources and w is not None:
            best = sorted((-sum(float(a) * float(b) for a, b in zip(e, x, strict=True)), j) for j, v, s, x in ok if v == w and j != i and j not in exclude and (section is None or s == section))[:n]
            out += [(i, j, round(-d, 6)) for d, j in best]
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark):
    return ann.build(spark.createDataFrame(vector_rows(), VECTORS).repartition(3), 16)


def queries(spark, rows, sources):
    some = [(i, w, e) for i, w, _, e in rows if i in sources and e is not None and len(e) > 1]
    return spark.createDataFrame(some, "source_id long, workspace_id string, q array<float>")


def found(df):
    return sorted((r["source_id"], r["paper_id"], round(r["score"], 6)) for r in df.collect())


def test_exact_search_is_the_scan(spark, index):
    rows, sources = vector_rows(), {*range(0, 900, 50), 8, 905, 5003, 5004, 5005, 5006}
    q = queries(spark, rows, sources)
    assert found(ann.search(index, q, n=10, probes=2)) == brute(rows, sources, 10)
    assert found(ann.search(index, q, n=3, probes=1, section="s1", exclude=[8, 900])) == brute(rows, sources, 3, "s1", (8, 900))
    assert found(ann.search(index, q, n=10, probes=2, least=0.8)) == [x for x in brute(rows, sources, 10) if x[2] >= 0.8]


def test_recall_of_few_probes(spark, index):
    rows, sources = vector_rows(), set(range(0, 900, 10))
    q = queries(spark, rows, sources)
    want = {x[:2] for x in brute(rows, sources, 10)}
    got = {x[:2] for x in found(ann.search(index, q, n=10, probes=max(2, len(index.centres) // 3), exact=False))}
    assert len(got & want) >= 0.9 * len(want)


def test_search_of_many_cells_reads_few_vectors(spark, monkeypatch):
    rng, read, exact = np.random.default_rng(5), [], ann._exact
    rows = [(i, "a", "s1", [float(c) for c in np.float32(x / np.linalg.norm(x))]) for i, x in enumerate(rng.normal(size=(3000, 16)))]
    ix, sources = ann.build(spark.createDataFrame(rows, VECTORS).repartition(3), 16), set(range(0, 3000, 300))

    def counted(index, found, *rest):
        assert "q" not in found.columns
        read.append(found.count())
        return exact(index, found, *rest)

    monkeypatch.setattr(ann, "_exact", counted)
    got = found(ann.search(ix, queries(spark, rows, sources), n=10, probes=len(ix.centres), exact=False))
    assert got == brute(rows, sources, 10)
    assert sum(read) <= 60 * len(sources)


def test_packs_are_not_broadcast(spark, index):
    rows = vector_rows()
    asked = queries(spark, rows, set(range(0, 900, 50))).withColumn("floor", F.lit(float("-inf")))
    pairs = ann._pairs(index, asked.localCheckpoint(), 4)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in ann._exact(index, pairs.selectExpr("source_ids[0] source_id", "cell", "keys[0] key", "paper_ids[0] paper_id"), asked.hint("merge"))._jdf.queryExecution().executedPlan().toString()


def test_queries_go_to_cells_in_bounded_batches(monkeypatch):
    rng, cells, dims, n = np.random.default_rng(7), 300, 16, 4000
    ix = ann.Index("", rng.normal(size=(cells, dims)), np.zeros((8, 1, 2)), np.where(np.arange(cells) % 7, 1.0, -1.0), 0, None)
    q = pa.ListArray.from_arrays(np.arange(0, n * dims + 1, dims, dtype=np.int32), np.float32(rng.normal(size=n * dims)))
    columns = {"source_id": np.arange(n), "workspace_id": ["a"] * n, "q": q, "floor": np.full(n, -np.inf)}
    for probes in (None, 240):
        out = list(ann._probes(ix, probes)(iter([pa.RecordBatch.from_pydict(columns), pa.RecordBatch.from_pydict(columns).slice(0, 0)])))
        assert max(b.num_rows for b in out) * dims <= ann.AT_ONCE
        want = min(probes or cells, int((ix.radius >= 0).sum()))
        assert sum(b.num_rows for b in out) == n * want and Counter(i for b in out for i in b.column(0).to_pylist()) == dict.fromkeys(range(n), want)
        assert out[-1].column("q")[-1].as_py() == q[n - 1].as_py()


def test_rows_are_encoded_in_bounded_batches():
    rng, cells, dims, n = np.random.default_rng(9), 500, 4, 9000
    centres, books, x = rng.normal(size=(cells, dims)), rng.normal(size=(2, 16, 2)), np.float32(rng.normal(size=(n, dims)))
    embedding = pa.ListArray.from_arrays(np.arange(0, n * dims + 1, dims, dtype=np.int32), x.ravel())
    b = pa.RecordBatch.from_pydict({"paper_id": np.arange(n), "workspace_id": ["a"] * n, "section": [None] * n, "embedding": embedding})
    out = list(ann._encoder(centres, books)(iter([b, b.slice(0, 0)])))
    assert max(o.num_rows for o in out) * cells <= ann.AT_ONCE
    assert [i for o in out for i in o.column("paper_id").to_pylist()] == list(range(n))
    near = ((x[:, None].astype(np.float64) - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [c for o in out for c in o.column("cell").to_pylist()] == near.tolist()


def test_one_query_reads_its_cells(spark, index):
    rows = vector_rows()
    df = ann.nearest(index, rows[8][3], "a", n=12, probes=2, exclude=[5006])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cell") >= 2 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert [r["paper_id"] for r in df.orderBy("rank").collect()] == [8, *range(900, 911)]


def test_index_holds_all_rows(spark, index):
    assert index.vectors().count() == index.rows == 964
    blocks = index.blocks().selectExpr("size(paper_ids) as n", "octet_length(codes) as bytes", "explode(paper_ids) as id")
    assert blocks.count() == 964 and blocks.agg(F.max("n")).first()[0] <= ann.BLOCK


def test_hot_cell_is_dealt_out(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, "a", "s", one) for i in range(5000)] + [(9000 + i, "a", "s", [0.0, float(i % 7), 1.0, 0.0]) for i in range(50)]
    ix = ann.build(spark.createDataFrame(rows, VECTORS).repartition(5), 4)
    assert ix.blocks().selectExpr("size(paper_ids) n").agg(F.max("n")).first()[0] <= ann.BLOCK
    got = ann.search(ix, spark.createDataFrame([(7, "a", one), (9001, "a", rows[5001][3])], "source_id long, workspace_id string, q array<float>"), n=5).collect()
    assert sorted(r["paper_id"] for r in got if r["source_id"] == 7) == [0, 1, 2, 3, 4]


def test_little_to_index(spark):
    for rows in ([], [(1, "a", "s", None)], [(1, "a", "s", [0.5, 0.5, 0.0])]):
        ix = ann.build(spark.createDataFrame(rows, VECTORS), 3)
        assert ann.search(ix, spark.createDataFrame([(2, "a", [1.0, 0.0, 0.0])], "source_id long, workspace_id string, q array<float>"), n=2).count() == len([r for r in rows if r[3]])


def texts():
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma-ray", "éclair", "x", "naïve", "50%", "a_b", "日本語", "𝒳yz", "beta", "delta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60])))) for i in range(400)]
    return rows + [(500, None), (501, ""), (502, "q"), (503, "qz"), (None, "alpha"), (7, "seven again ZETA"), (504, "a" * 30000), (505, "?\x00\n tab\tend")]


TERMS = ["alpha", "BETA", "a x", "x", "é", "日本", "𝒳", "50%", "a_b", "%", "_", "zeta", "nothing here", "qz", "q", "z", "aaaaaaaa", "\n", "?", "b", "", "naïve é", "ta\tend"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(texts(), "id long, body string").repartition(3).persist()


@pytest.fixture(scope="module")
def grams(spark, table):
    return postings.build(table, "id", "body", part=50)


def test_substrings(spark, table, grams):
    for term in TERMS:
        want = sorted((i, t) for i, t in texts() if i is not None and t is not None and term.lower() in t.lower())
        assert sorted(map(tuple, postings.containing(grams, table, "id", "body", term).collect())) == want, term


def test_any_of_some_terms(spark, table, grams):
    got = sorted(r["id"] for r in postings.containing_any(grams, table, "id", "body", ["zeta", "qz", "50%"]).collect())
    assert got == sorted(i for i, t in texts() if i is not None and t and any(x in t.lower() for x in ("zeta", "qz", "50%")))


def test_terms_of_a_table(spark, table, grams):
    terms = spark.createDataFrame([*enumerate(TERMS), (99, None)], "term_id int, term string")
    df = postings.matches(grams, table, "id", "body", terms)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(k, i) for k, x in enumerate(TERMS) for i, t in texts() if x and i is not None and t is not None and x.lower() in t.lower()}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_very_many_terms(spark, table):
    rng = random.Random(9)
    some = [*TERMS, "a" * 32, "a" * 33, "a" * 64, "a" * 200, "y" * 5, "mma-r"]
    for i, t in texts():
        if t and i is not None:
            at, n = rng.randrange(len(t)), rng.choice([1, 2, 3, 7, 32, 40])
            some.append(t[at : at + n])
    want = {(k, i) for k, x in enumerate(some) for i, t in texts() if x and i is not None and t is not None and x.lower() in t.lower()}
    terms = spark.createDataFrame([*enumerate(some), (9999, None)], "term_id int, term string")
    got = [tuple(r) for r in postings.holding(table, "id", "body", terms).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert postings.holding(table, "id", "body", terms.where("term_id = 9999")).count() == 0


def test_words_of_terms_are_joined_not_looked_for(spark):
    # The names of a table stand in all of its texts' words: each text is read once, and no pair of a text and a name is looked through.
    rows = spark.createDataFrame([(i, f"Name{i} is in thename{i}s and the{i % 3}") for i in range(200)], "id long, body string")
    df = postings.holding(rows, "id", "body", rows.select(F.col("id").alias("term_id"), F.concat(F.lit("name"), "id").alias("term")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "body" not in plan
    assert df.count() == sum(str(j).startswith(str(i)) for i in range(200) for j in range(200))


def test_words_parts_and_pairs_are_not_exchanged(spark, monkeypatch):
    # Rows of three words and sets of some five terms: parts are dealt to rows and terms to joins, and each pair still comes up once.
    monkeypatch.setattr(postings, "WORDS", 3)
    monkeypatch.setattr(postings, "TERMS", 5)
    rng = random.Random(5)
    texts_ = {i: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 20))) for i in range(40)}
    terms = {k: "".join(rng.choice("abC") for _ in range(rng.randrange(1, 5))) for k in range(30)}
    df = postings.holding(spark.createDataFrame([*texts_.items()], "id long, body string"), "id", "body", spark.createDataFrame([*terms.items()], "term_id int, term string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, i) for k, x in terms.items() for i, t in texts_.items() if x.lower() in t}


def test_postings_alone_are_read(spark, grams):
    plan = postings.candidates(grams, "gamma-ray")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan and "In(gram" in plan and "body" not in plan
    short = postings.candidates(grams, "ga")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,ga)" in short
    assert grams.rows().agg(F.max(F.size("ids"))).first()[0] < 100  # parts of about 50


def test_grams_meet_in_lists_not_rows(spark):
    # What is exchanged is a row for each gram and part of a task, not for each gram of each text.
    rows = spark.createDataFrame([(i % 250, f"the same words {i % 3} 𝒳é") for i in range(500)], "id int, body string").coalesce(1)
    ix = postings.build(rows, "id", "body", part=100)
    got = {(r["gram"], r["part"]): r["ids"] for r in ix.rows().collect()}
    want = {}
    for r in rows.collect():
        t = r["body"].lower() + postings.END
        for i in range(len(t) - 2):
            want.setdefault(t[i : i + 3], set()).add(r["id"])
    have = {}
    for (g, _), ids in got.items():
        assert ids == sorted(set(ids))
        have.setdefault(g, []).extend(ids)
    assert {g: sorted(x) for g, x in have.items()} == {g: sorted(x) for g, x in want.items()}
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 2, 3], "part": pa.array([0, 1, 1, 0], pa.int32()), "text": ["abcabc", "abc", "xbc", "ab"]})
    runs = [(r["gram"], r["part"], r["ids"]) for b in postings._inverted(iter([batch])) for r in b.to_pylist()]
    assert sorted(runs) == [("abc", 0, [1]), ("abc", 1, [2]), ("bca", 0, [1]), ("cab", 0, [1]), ("xbc", 1, [2])]


def test_no_texts(spark):
    none = postings.build(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert postings.candidates(none, "abc").count() == 0 and postings.candidates(none, "a").count() == 0


def test_one_file_is_work_for_all_cores(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"The text {i}", "en", "web", 10) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for df in (co.chunks(spark, str(tmp_path)), co.papers(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tokens_are_taken_once(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, content string")
    df = rows.select("id", bm25(F.array(F.lit("a"), F.lit("b")), tokens(F.col("content")), F.lit(2.0)).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r["id"]: r["s"] for r in df.collect()}
    assert got[1] > 1 and got[2] == 0


def test_tokens_are_counted_in_their_row(spark):
    rng = random.Random(2)
    lists = [[], ["x"], ["x"] * 5, *([rng.choice(["a", "b", "é", "", "b-"]) for _ in range(rng.randrange(40))] for _ in range(30))]
    df = spark.createDataFrame([*enumerate(lists)], "id int, toks array<string>").select("id", impact._counted("toks").alias("c"))
    assert {r["id"]: [tuple(x) for x in r["c"]] for r in df.collect()} == {i: sorted(Counter(x).items()) for i, x in enumerate(lists)}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_all_vectors_are_products_not_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PART", 100)
    rows = vector_rows()
    v = spark.createDataFrame([*rows, (6000, "a", "s1", [0.1, None] * 8), (6001, "b", "s1", [0.1] * 15)], VECTORS)
    df = retrieve.similar_pairs(v.where("paper_id % 50 = 0 or paper_id in (8, 905, 6000, 6001, 5001)"), v.where("paper_id <> 5002"), n=7, least=0.3, block=10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    sources = {*range(0, 900, 50), 8, 905, 900, 950, 5000, 6000}
    assert found(df) == [x for x in brute(rows, sources & {r[0] for r in rows if r[3] and len(r[3]) > 1}, 7) if x[2] >= 0.3]
