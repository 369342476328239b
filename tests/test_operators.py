"""Operators on small relations."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.operators import graph, layout, ner, retrieve, synth
from quillmine.plans.engine import Engine, NotFoundError
from quillmine.plans.indexed import QUERIES as INDEXED
from quillmine.sources import readers, sinks
from quillmine.streaming import ingest

LINES = "paper_id long, page int, ord int, text string, size double, bold boolean, y double"


def test_layout(spark):
    rows = [
        (1, 0, 0, "A first candidate title", 18.0, True, 100.0), (1, 0, 1, "A second candidate title", 18.0, True, 130.0),
        (1, 0, 2, "Anna Smith, Bob Jones and anna smith", 11.0, False, 200.0), (1, 0, 3, "Results", 14.0, True, 300.0), (1, 0, 4, "one", 9.0, False, 310.0),
        (1, 0, 5, "References", 14.0, True, 400.0), (1, 0, 6, "gone", 9.0, False, 410.0), (1, 0, 7, "Experiments", 12.0, True, 500.0), (1, 0, 8, "two", 9.0, False, 800.0),
    ]
    x = spark.createDataFrame(rows, LINES)
    t = layout.titles(x)
    assert t.first()["title"] == "A second candidate title"
    assert layout.authors(x, t).first()["authors"] == ["Anna Smith", "Bob Jones"]
    got = {r["section"]: r["text"] for r in layout.sections(x).collect()}
    assert got["results"] == "one\ntwo" and "gone" not in "".join(got.values())


def test_rank_pairs(spark):
    names = ["Alpha Beta", "Gamma Delta", "Kappa Zeta", "Omega Theta", "Sigma Rho"]
    rows = [(7, i, n, "METHOD", 9 - i) for i, n in enumerate(names)]
    links = spark.createDataFrame(rows, "paper_id long, entity_id long, name string, entity_type string, frequency int")
    got = {(names.index(r["source"]) + 1, names.index(r["target"]) + 1) for r in graph.co_mentions(links).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)}


def test_co_mention_confidence(spark):
    rows = [(1, 1, "Deep Learning", "METHOD", 1), (1, 2, "TP53", "PROTEIN", 1)]
    links = spark.createDataFrame(rows, "paper_id long, entity_id long, name string, entity_type string, frequency int")
    assert graph.co_mentions(links).select(F.round("confidence", 4)).first()[0] == 0.632


def test_trails_use_a_relation_once(spark):
    rel = spark.createDataFrame([(1, 1, 2, 9), (2, 2, 3, 9), (3, 2, 2, 9), (4, 3, 1, 9)], "id long, source_entity_id long, target_entity_id long, paper_id long")
    got = graph.trails(rel, [1], 4).collect()
    assert all(len(set(r["edges"])) == len(r["edges"]) for r in got)
    assert [1, 3, 2] in [r["edges"] for r in got]


def test_ranked_hypotheses(spark):
    rows = [(0, 0.72, 0.65), (1, 0.68, 0.80), (2, 0.70, 0.72), (3, 0.30, 0.99)]
    got = synth.ranked(spark.createDataFrame(rows, "ord int, confidence double, novelty double")).collect()
    assert [r["score"] for r in got] == [0.544, 0.504, 0.468]


def test_hypothesis_rules(spark):
    types = spark.createDataFrame([("DISEASE", ["Flu"]), ("METHOD", ["CNN", "RNN"])], "entity_type string, names array<string>")
    none = spark.createDataFrame([], "rank int, sentence string")
    got = synth.hypotheses(types, none, "q", 3).collect()
    assert {r["rule"] for r in got} == {"disease_method", "fill"} and len(got) == 3
    assert "Applying CNN to larger multi-institutional cohorts of Flu patients" in got[0]["hypothesis"]


def test_extraction(spark):
    t = "Deep learning helps Parkinson disease patients. BERT and BERT on ImageNet. TP53 rises; aspirin? Lesion found."
    names = ner.extracted(spark.createDataFrame([(1, 1, t, 0.9)], "paper_id long, id long, content string, importance_score double"))
    got = {(r["type"], r["name"]) for r in names.collect()}
    assert {("METHOD", "Deep Learning"), ("DISEASE", "Parkinson disease"), ("METHOD", "BERT"), ("DATASET", "ImageNet"), ("PROTEIN", "TP53"), ("DISEASE", "Lesion")} <= got


def test_extraction_of_endless_runs(spark):
    runs = "Thatin Ononst " * 5000 + "Folic acid. [" + "12, " * 5000 + "3] TP53"
    chunks = spark.createDataFrame([(1, 1, runs, 0.9), (2, 2, "Low [1, 2] TP53", 0.1)], "paper_id long, id long, content string, importance_score double")
    got = {(r["paper_id"], r["type"], r["name"]) for r in ner.extracted(chunks).collect()}
    assert {(1, "PROTEIN", "TP53"), (1, "CONCEPT", "Thatin"), (2, "PROTEIN", "TP53")} <= got
    assert not [x for x in ner.texts(chunks).collect() if "12" in x["text"] or "[1" in x["text"]]


def test_texts_are_taken_once_for_all_names(spark, tmp_path):
    spark.createDataFrame([(1, 1, "TP53", 0.9)], "paper_id long, id long, content string, importance_score double").write.parquet(str(tmp_path / "c"))
    plan = ner.extracted(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("ArrowEvalPython") == 1


def test_upsert_counts_spellings(spark):
    new = spark.createDataFrame([(1, "w", "METHOD", "BRCA-1", 1), (1, "w", "METHOD", "BRCA 1", 2)], "paper_id long, workspace_id string, type string, name string, rank int")
    once = ner.upserted(None, new)
    assert once.first()["paper_count"] == 2 and once.first()["normalized_name"] == "w:brca1"
    assert ner.upserted(once, new).first()["paper_count"] == 4


def test_merge_keeps_the_better(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.4)], "id string, score double")
    b = spark.createDataFrame([("x", 0.6), ("y", 0.4), ("z", 0.1)], "id string, score double")
    got = [(r["id"], r["score"], r["src"]) for r in retrieve.merged_results(a, b, 2).collect()]
    assert got == [("x", 0.6, 1), ("y", 0.4, 0)]


def test_fact_edges(spark):
    nodes = spark.createDataFrame([(0, "a", "X"), (1, "b", "x"), (2, "c", "Z")], "ord long, id string, label string")
    facts = spark.createDataFrame([(0, "x", "none", "r", None), (1, "z", "X", "r", 0.9)], "ord long, source string, target string, relationship string, confidence double")
    got = sorted((r["source"], r["target"], r["confidence"]) for r in graph.fact_edges(facts, nodes).collect())
    assert got == [("b", "b", 0.55), ("c", "b", 0.9)]


W1, W2 = "a" * 36, "b" * 36


@pytest.fixture
def engine(spark):
    papers = spark.createDataFrame([(1, W1, "T1", "graph graph text", 2020, "completed"), (2, W2, "T2", "graph", 2021, "pending")], "id long, workspace_id string, title string, raw_text string, publication_year int, processing_status string")
    chunks = spark.createDataFrame([(i, 1 + i % 2, (W1, W2)[i % 2], "results", f"The graph network number {i} improves novel results by a lot of measured percent here.", 0.9) for i in range(6)], "id long, paper_id long, workspace_id string, section string, content string, importance_score double")
    entities = spark.createDataFrame([(10, W1, f"{W1}:graphnet", "GraphNet", 1, "METHOD"), (11, W2, f"{W2}:graphnet", "GraphNet", 1, "METHOD")], "id long, workspace_id string, normalized_name string, name string, paper_count int, entity_type string")
    links = spark.createDataFrame([(1, 10, 2), (2, 11, 1)], "paper_id long, entity_id long, frequency int")
    rel = spark.createDataFrame([], "id long, source_entity_id long, target_entity_id long, relationship_type string, confidence double, paper_id long")
    hyp = spark.createDataFrame([(1, W1, "h", 0.9, [1], 0)], "id long, workspace_id string, hypothesis_text string, confidence_score double, supporting_paper_ids array<long>, upvotes int")
    return Engine(papers, chunks, entities, links, rel, None, hyp, workspace=W1)


def test_engine_sees_its_workspace(engine):
    assert [r["id"] for r in engine.papers().collect()] == [1]
    assert {r["paper_id"] for r in engine.search("graph network").collect()} == {1}
    assert engine.paper(1).first()["graph_built"]
    with pytest.raises(NotFoundError):
        engine.paper(2)
    assert engine.answer("graph network").first()["n_results"] == 3
    assert engine.landscape("GRAPH").first()["paper_count"] == 1
    assert engine.upvote(1).first()["upvotes"] == 1 and engine.debate(1).first()["final_confidence"] == 0.7
    assert engine.contradictions("graph", [1, 2]).first()["contradiction_type"] == "insufficient_data"
    assert {r["name"]: r["deleted"] for r in engine.reset_workspace().collect()} == {"papers": 1, "chunks": 3, "entities": 1, "links": 1, "relations": 0, "hypotheses": 1}
    assert engine.links.count() == 1 and engine.hypotheses_.count() == 0
    with pytest.raises(ValueError):
        engine.workspace_id("x")


def test_answers_look_at_all_chunks(engine, spark):
    said = "The graph network improves novel results by a lot of measured percent in every one of the trials."
    rows = [(i, 1, W1, "results", "Nothing of the kind is said here.", 0.9) for i in range(250)] + [(900, 1, W1, "methods", said, 0.5)]
    engine.chunks = spark.createDataFrame(rows, "id long, paper_id long, workspace_id string, section string, content string, importance_score double")
    got = engine.answer("graph network").first()
    assert got["n_results"] == 1 and said in got["answer"]
    assert retrieve.lexical_search(engine.chunks, "graph network", 8).count() == 0
    assert [r["id"] for r in retrieve.lexical_search(engine.chunks, "the", 8, None).collect()] == [r["id"] for r in retrieve.lexical_search(engine.chunks, "the", 8).collect()]


def test_landscape_of_all_papers(spark):
    papers = spark.range(150).selectExpr("id", "concat('Of GRAPHS ', id) AS raw_text", "CAST(IF(id = 149, 1999, 2000 + id % 3) AS INT) AS publication_year")
    assert tuple(retrieve.landscape(papers, "graph").first()) == (100, 2000, 2002)
    assert tuple(retrieve.landscape(papers, "graph", None).first()) == (150, 1999, 2002)


def test_landscape_indexed_counts_all_papers(spark, tmp_path):
    d = spark.range(150).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'Of THATIN here', 'a thatins') AS text", "'en' AS lang")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert INDEXED["landscape_indexed"](spark, str(tmp_path)).first()["paper_count"] == 150
    assert INDEXED["landscape"](spark, str(tmp_path)).first()["paper_count"] == 100


def test_status(spark):
    p = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, processing_status string")
    c = spark.createDataFrame([(1, 1, "processing"), (1, 2, "completed")], "id long, ts long, status string")
    assert sorted(tuple(r) for r in sinks.with_status(p, c).select("id", "processing_status").collect()) == [(1, "completed"), (2, "pending")]


def test_stream_equals_batch(spark, tmp_path):
    sections = spark.createDataFrame([(1, "results", "Graph nets are strong in this trial."), (2, "other", "However Alpha and Beta differ.")], "paper_id long, section string, text string")
    sections.write.parquet(str(tmp_path / "in"))
    stream = ingest.chunk_stream(ingest.section_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(ingest.entity_writer(str(tmp_path / "out"), "w")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["name"] for r in ingest.entities_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {"Graph", "However", "Alpha", "Beta"}


def test_papers_and_topics(engine, spark):
    assert [tuple(r) for r in engine.papers_by_id([2, 1]).collect()] == [(1, "T1", 2020)] and engine.papers_by_id([]).count() == 0
    v = spark.createDataFrame([(1, W1, "results", [1.0, 0.0], 0.9), (3, W1, "results", [0.9, 0.1], 0.5)], "paper_id long, workspace_id string, section string, embedding array<double>, importance_score double")
    engine.vectors = v
    engine.papers_ = engine.papers_.unionByName(spark.createDataFrame([(3, W1, "T3", "graph", 2021, "completed")], engine.papers_.schema))
    engine.chunks = engine.chunks.unionByName(spark.createDataFrame([(9, 3, W1, "results", "Another graph text.", 0.9)], engine.chunks.schema))
    got = engine.contradictions("graph", [1, 3], [1.0, 0.0]).first()
    assert got["contradiction_type"] == "model_error" and got["severity"] == "LOW"
    seen = {}
    engine.contradictions("graph", [1, 3], verdict=lambda p: seen.update({"rows": p.collect()}) or p)
    assert "GraphNet" not in seen["rows"][0]["text_b"] and "Another graph text." in seen["rows"][0]["text_b"]
    assert [r["paper_id"] for r in engine.connections(1).collect()] == [3]


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, "w", [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    v = spark.createDataFrame(rows, "paper_id long, workspace_id string, embedding array<double>")
    one = retrieve.similar_pairs(v.where("paper_id % 3 = 0"), v, n=4, least=0.5)
    blocks = retrieve.similar_pairs(v.where("paper_id % 3 = 0"), v, n=4, least=0.5, block=7)
    plain = lambda df: sorted((r["source_id"], r["paper_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert plain(one) == plain(blocks) and len(plain(one)) > 100


def test_simple_sections_keep_what_is_skipped(spark):
    df = spark.createDataFrame([(1, "first\nMethods\nwe did\n\nReferences\n[1] x\nmethods\nmore")], "paper_id long, text string")
    assert {r["section"]: r["text"] for r in layout.simple_sections(df).collect()} == {"other": "first", "methods": "we did\nmore", "SKIP": "[1] x"}


def test_node_labels(spark):
    n = spark.createDataFrame([("a1", "Graph"), ("b1", None), ("c1", "")], "id string, label string")
    ids = lambda t: sorted(r["id"] for r in graph.labelled(n, t).collect())
    assert ids("GRA") == ["a1"] and ids("b") == ["b1"] and ids(" ") == ["a1", "b1", "c1"]


def test_refined_names(spark):
    names = spark.createDataFrame([(1, "GENE", "TP53", 4, 1), (1, "GENE", "Foo", 2, 2), (2, "GENE", "BRCA1", 1, 1)], "paper_id long, type string, name string, n long, rank int")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "paper_id long, text string")

    def refine(text, by_type):
        if text == "two":
            raise RuntimeError("no model")
        return {"GENE": by_type["GENE"][:1], "DISEASE": ["flu"]}

    assert sorted(tuple(r) for r in ner.refined(texts, names, refine).collect()) == [(1, "DISEASE", "flu", 1, 1), (1, "GENE", "TP53", 4, 1), (2, "GENE", "BRCA1", 1, 1)]


def test_models():
    said = []

    def generate(prompt):
        said.append(prompt)
        if len(said) == 1:
            raise TimeoutError
        return "no json" if len(said) == 2 else 'so: ```json\n{"hypotheses": [], "meta_insights": {}}```'

    model = synth.Model(generate, wait=0)
    assert model.structured("p", ("hypotheses", "meta_insights")) == {"hypotheses": [], "meta_insights": {}} and len(said) == 3
    with pytest.raises(ValueError, match="meta_insights"):
        synth.checked({"hypotheses": []})
    with pytest.raises(ValueError):
        synth.Model(lambda p: "[]").structured("p")
    with pytest.raises(ConnectionError):
        synth.Model(lambda p: (_ for _ in ()).throw(ConnectionError()), wait=0)("p")


def test_debate_rounds(spark):
    h = spark.createDataFrame([(1, "h", 0.9)], "id long, hypothesis string, confidence double")
    got = synth.debate(h, lambda agent, text, so_far: f"{agent} on {text} after {len(so_far)}", lambda t: {"consensus": "CONTESTED", "final_confidence": 0.4, "key_concerns": ["c"]}, 9).first()
    assert len(got["transcript"]) == 3 + 3 * 4 + 1 and got["transcript"][3]["content"] == "domain_expert on h after 3" and got["consensus"] == "CONTESTED" and got["key_concerns"] == ["c"]
    assert len(synth.debate(h).first()["transcript"]) == 4


def test_extracted_names_are_those_of_plain_python(spark):
    """The whole extraction against regular expressions that know all letters."""
    import unicodedata

    rng = random.Random(8)
    words = ["TP53", "BRCA1-A", "été kinase", "Parkinson disease", "imatinib", "deep learning", "ImageNet", "Été", "COVID-19", "the", "of", "Foo-Bar", "protein receptor", "Graph framework", "ß-x", "IL2", "transformer", "cancer"]
    rows = [(i, 0, " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(60)), 0.9) for i in range(12)]
    chunks = spark.createDataFrame(rows, "paper_id long, id long, content string, importance_score double")
    got = sorted((r["paper_id"], r["type"], r["name"], r["n"], r["rank"]) for r in ner.extracted(chunks).collect())
    cleaned = {r["paper_id"]: r["text"] for r in ner.texts(chunks).collect()}
    blank = lambda x: " ".join(x.split())
    valid = lambda x: 2 <= len(x) <= 80 and any(unicodedata.category(c)[0] == "L" for c in x) and any(w not in lx.ENTITY_BLACKLIST for w in x.lower().split(" "))
    key = lambda x: re.sub(r"[\s\-_]", "", x.lower())
    want = []
    for pid, text in cleaned.items():
        total, types = collections.Counter(), collections.defaultdict(set)
        for kind, patterns in lx.NER_PATTERNS.items():
            count, first = collections.Counter(), {}
            for i, p in enumerate(patterns):
                for k, m in enumerate(re.finditer(p, text)):
                    name = blank(m[1])
                    if valid(name):
                        count[name] += 1
                        first.setdefault(name, (i, k))
            best = {}
            for name in sorted(count, key=lambda x: (-count[x], len(x), first[x], x)):
                best.setdefault(key(name), name)
            for name in sorted(best.values(), key=lambda x: (-count[x], x.lower(), x))[: lx.NER_TOP]:
                total[name] += count[name]
                types[kind].add(name)
        for p, kind in lx.PHRASES.items():
            if n := text.lower().count(p):
                name = lx.ACRONYM_PHRASES.get(p, " ".join(w.capitalize() for w in p.split()))
                total[name] += n
                types[kind].add(name)
        for m in re.finditer(lx.CONCEPT, text):
            if m[0] not in lx.CONCEPT_STOP and valid(m[0]):
                total[m[0]] += 1
                types["CONCEPT"].add(m[0])
        for kind, names in types.items():
            for rank, name in enumerate(sorted(names, key=lambda x: (-total[x], x.lower(), x))[: lx.TYPE_TOP], 1):
                want.append((pid, kind, name, total[name], rank))
    assert got == sorted(want)


def test_paths_are_all_trails_that_end_there(spark):
    rng = random.Random(6)
    rel = [(i, rng.randint(1, 9), rng.randint(1, 9), i % 3) for i in range(18)]
    r = spark.createDataFrame(rel, "id long, source_entity_id long, target_entity_id long, paper_id long")
    want = graph.trails(r, [1, 2], 4).where(F.element_at("nodes", -1).isin(3, 4)).orderBy("hops", "edges").select("nodes", "edges", "papers", "hops").collect()
    assert len(want) > 40
    for limit in (1, 7, len(want), len(want) + 5):
        got = graph.paths_between(r, [1, 2], [3, 4], 4, limit).select("nodes", "edges", "papers", "hops").collect()
        assert [(x["hops"], x["edges"]) for x in got] == [(x["hops"], x["edges"]) for x in want][:limit]
    assert sorted(map(tuple, (map(str, x) for x in graph.paths_between(r, [1, 2], [3, 4], 4, 10_000).select("nodes", "edges", "papers", "hops").collect()))) == sorted(map(tuple, (map(str, x) for x in want)))
    assert graph.paths_between(r, [], [3]).count() == graph.paths_between(r, [1], []).count() == 0


def test_uploads_go_through_their_states(spark):
    files = spark.createDataFrame([("/in/a.PDF",), ("/in/b.pdf",), ("/in/b.pdf",), ("/in/c.txt",)], "path string")
    new = readers.uploaded(files, "w").unionByName(readers.requested(spark.createDataFrame([("2401.1",), (None,)], "arxiv_id string"), "w"))
    papers = sinks.registered(spark.createDataFrame([], readers.PENDING), new)
    papers = sinks.registered(papers, new)
    by = {r["title"]: r for r in papers.collect()}
    assert sorted(by) == ["a.PDF", "arXiv:2401.1", "b.pdf"] and all(r["processing_status"] == "pending" for r in by.values())
    a, b, c = (by[t]["id"] for t in ("a.PDF", "b.pdf", "arXiv:2401.1"))
    changes = spark.createDataFrame([(a, 1, "processing"), (b, 1, "completed"), (c, 2, "failed"), (c, 1, "processing")], "id long, ts long, status string")
    papers = sinks.stepped(papers, changes)
    assert {r["id"]: r["processing_status"] for r in papers.collect()} == {a: "processing", b: "pending", c: "failed"}
    papers = sinks.stepped(papers, spark.createDataFrame([(b, 3, "processing"), (c, 3, "processing")], "id long, ts long, status string"))
    papers = sinks.parsed(papers, spark.createDataFrame([(a,), (a,), (c,)], "paper_id long"))
    assert {r["id"]: r["processing_status"] for r in papers.collect()} == {a: "completed", b: "failed", c: "completed"}
