"""Worked examples of the column functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmine.functions import scores, segments, text
from quillmine.operators import layout, synth
from quillmine.sources.readers import atom_entry


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.join_hyphens, "multi-\ncenter", "multicenter"),
        (text.close_formulas, "1 . 2 . 3", "1.2 . 3"),
        (lambda x: text.close_formulas(text.close_formulas(x)), "1 . 2 . 3", "1.2.3"),
        (text.mark_citations, "see [1, 2 3].", "see [CITE]."),
        (text.mark_citations, "(Smith et al., 2020)", "[CITE]"),
        (text.join_lines, "a\nb\n\nc", "a b\n\nc"),
        (text.ligatures, "ﬁne eﬀect", "fine effect"),
        (text.nfkc, "ﬁ ²", "fi 2"),
        (text.canonical_key, "BRCA-1", "brca1"),
        (text.canonical_key, "brca 1", "brca1"),
        (text.canonical_key, "BRCA_1", "brca1"),
        (text.relation_label, " Treats ", "treats"),
        (text.relation_label, "INHIBITS", "inhibits"),
        (text.relation_label, "unknown", "correlates_with"),
        (text.entity_label, "DRUG", "CHEMICAL"),
        (text.singular, "lesions", "lesion"),
        (text.singular, "gas", "gas"),
        (text.phrase_name, "ehr", "EHR"),
        (text.phrase_name, "real-time deployment", "Real-time Deployment"),
        (text.collapse, " a \n\t b ", "a b"),
        (text.clean, None, ""),
        (lambda x: text.clean(x, aggressive=True), "A (see x) [1] b", "A b"),
        (layout.doi_of, "… 10.1000/xyz123. Published 2019", "10.1000/xyz123."),
        (layout.year_of, "in 12019 and 2019 or 2020", 2019),
        (layout.abstract_of, "Abstract We do.\n1 Introduction\nx", "We do."),
        (layout.normal_header, "1. Introduction", "introduction"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


@pytest.mark.parametrize(("section", "content", "want"), [("results", "We show a significant 12% improvement.", 1.0), ("other", "However only 5% remained.", 0.48), ("nowhere", "plain text", 0.4)])
def test_importance(spark, section, content, want):
    assert one(spark, F.round(segments.importance(F.col("s"), F.col("c")), 4), s=section, c=content) == want


@pytest.mark.parametrize(("line", "size", "bold", "want"), [("Abstract", 12, True, "abstract"), ("1 Introduction", 12, True, "introduction"), ("References", 10.5, False, "SKIP"), ("plain words", 20, True, None), ("Results", 10.9, False, None)])
def test_header(spark, line, size, bold, want):
    assert one(spark, layout.header(F.col("t"), F.lit(float(size)), F.lit(bold)), t=line) == want


def test_sentences(spark):
    t = "Smith et al. Showed this result is strong. Fig. 3 shows p < 0.05. The next one agrees with it."
    got = one(spark, segments.sentences(F.col("t")), t=t)
    assert got == ["Smith et al. Showed this result is strong.", "Fig. 3 shows p < 0.05. The next one agrees with it."]


def words(n, k):
    return " ".join(f"w{k}" for _ in range(n))


@pytest.mark.parametrize(("compat", "want"), [(False, [200, 50, 200, 30]), (True, [200, 250, 450, 480])])
def test_packing(spark, compat, want):
    parts = [words(n, i) for i, n in enumerate([100, 100, 50, 200, 30])]
    got = one(spark, segments.packed(F.col("p"), compat_prefix=compat), p=parts)
    assert [len(x.split()) for x in got] == want


@pytest.mark.parametrize(("n", "want"), [(308, [154, 154]), (307, [307])])
def test_resizing(spark, n, want):
    assert [len(x.split()) for x in one(spark, segments.resized(F.col("p")), p=[words(n, 0)])] == want


def test_short_pieces_join_the_one_before(spark):
    assert [len(x.split()) for x in one(spark, segments.resized(F.col("p")), p=[words(50, 0), words(39, 1), words(40, 2)])] == [89, 40]


def test_query_terms(spark):
    assert one(spark, scores.query_terms(F.lit("What does graph-based graph learning show about data?"))) == ["graph", "based", "graph", "learning"]


def test_scores(spark):
    toks = ["graph", "graph", *["x"] * 8]
    assert one(spark, F.round(scores.bm25(F.array(F.lit("graph")), F.col("k"), F.lit(10.0)), 4), k=toks) == 1.4286
    terms = F.array(F.lit("graph"), F.lit("network"))
    assert one(spark, F.round(scores.lexical(terms, F.col("t")), 4), t="graph graph") == 0.585
    assert one(spark, scores.hybrid(F.lit(1.4286), F.array(F.lit("graph")), F.lit(0.5), F.lit(0.86))) == 0.779


@pytest.mark.parametrize(("name", "kind", "want"), [("Deep Learning", "METHOD", 2.8), ("TP53", "PROTEIN", 2.5), ("the", "CONCEPT", 0.0), ("Model", "METHOD", 0.0), ("ab", None, 0.0)])
def test_strength(spark, name, kind, want):
    assert one(spark, F.round(scores.strength(F.col("n"), F.lit(kind).cast("string")), 4), n=name) == want


@pytest.mark.parametrize(("a", "b", "want"), [("lesion", "lesions", True), ("MS", "MSX", False), ("A", "a", True)])
def test_similar_names(spark, a, b, want):
    assert one(spark, scores.too_similar(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("given", "want"), [('```json\n{"a":1}\n```', "1"), ('noise {"a":1} tail', "1"), ("nothing", None)])
def test_json(spark, given, want):
    assert one(spark, F.try_variant_get(text.recovered_json(F.col("t")), "$.a", "string"), t=given) == want


def test_metrics(spark):
    row = spark.range(1).select(*synth.discovery_metrics(F.lit(8), F.lit(24), F.lit(6))).first()
    assert tuple(row) == (7.7, 10.0, 9.3, 5.2)


def test_atom(spark):
    xml = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A  b</title><summary>c\n d</summary><author><name>X Y</name></author><author><name>Z</name></author><published>2020</published></entry></feed>"
    got = one(spark, atom_entry(F.col("t")), t=xml)
    assert (got["title"], got["abstract"], got["authors"], got["published"]) == ("A b", "c d", ["X Y", "Z"], "2020")


def test_nfkc_of_runs_is_that_of_the_text(spark):
    rng = random.Random(4)
    marks = "aAzZ1 <=>.\n\r\x01\x7f̸̧́é²ﬁ각가क़゙か\U0001d4b3\U0001d165  ̈́\u0085"
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(30)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "plain\n"), (1003, "́"), (1004, "xé")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", text.nfkc(F.col("t")).alias("n"))
    assert {r["id"]: r["n"] for r in df.collect()} == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in rows}


def test_nfkc_sends_runs_not_texts(spark):
    plan = spark.createDataFrame([("a²",)], "t string").select(text.nfkc(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    sent = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "regexp_extract_all" in plan and "_nfkc(t#" not in sent
