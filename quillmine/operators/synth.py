"""Answers, hypotheses, contradictions, debate: templates over a few ranked rows; models are optional functions."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.segments import any_of
from quillmine.functions.text import clean, first_words


def by_type(links: DataFrame, limit: int = 80, per_type: int = 8) -> DataFrame:
    """entity_type, names: of the limit most frequent links (entity_type, name, frequency, paper_count, entity_id)."""
    top = links.orderBy(F.desc("frequency"), F.desc("paper_count"), "entity_id", "paper_id").limit(limit)
    order = Window.partitionBy("entity_type").orderBy(F.desc("frequency"), F.lower("name"), "name", "entity_id", "paper_id")
    best = top.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_type)
    return best.groupBy("entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))


def evidence_sentences(results: DataFrame, of: int = 4) -> DataFrame:
    """rank, sentence: of each of the first results the first sentence that is long enough and says something."""
    parts = F.filter(F.split("content", r"\. "), lambda s: (F.char_length(s) > 60) & any_of(F.lower(s), lx.EVIDENCE_WORDS))
    return results.where(F.col("rank") <= of).select("rank", F.trim(F.try_element_at(parts, F.lit(1))).alias("sentence")).where("sentence is not null")


def dominant_themes(types: DataFrame, n: int = 4) -> DataFrame:
    return types.select("entity_type", F.get("names", F.lit(0)).alias("theme")).orderBy("entity_type").limit(n)


def hypotheses(types: DataFrame, sentences: DataFrame, query: str, count: int, results: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Up to count hypotheses by rules, in the rules' order, each with confidence, novelty, text, reasoning, experiments, evidence
    and gaps; ranked afterwards.

    types (entity_type, names), sentences (rank, sentence), results (rank, title, section, content) and gaps (gaps) are a few
    rows; they meet in one row of first names.
    """
    first = lambda t: F.max(F.when(F.col("entity_type") == t, F.get("names", F.lit(0))))
    row = types.agg(
        first("DISEASE").alias("disease"), first("METHOD").alias("method"), F.coalesce(first("PROTEIN"), first("GENE")).alias("protein"),
        first("CHEMICAL").alias("chemical"), first("DATASET").alias("dataset"),
    )
    said = sentences.agg(F.min_by("sentence", "rank").alias("whole"))
    both = row.crossJoin(said).withColumn("sentence", F.substring("whole", 1, 140)).withColumn("query", F.lit(query))
    item = lambda title, section, excerpt, relevance: F.struct(title.alias("paper_title"), section.alias("section"), excerpt.alias("excerpt"), relevance.alias("relevance"))
    if results is not None:
        shown = item(F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), first_words(F.col("content"), 45), F.lit(lx.EVIDENCE_RELEVANCE))
        top = results.where("rank <= 3").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("e")))), lambda x: x["e"]).alias("evidence"))
    else:
        top = types.limit(0).agg(F.collect_list(item(*[F.lit("")] * 4)).alias("evidence"))
    known = gaps.agg(F.first("gaps").alias("gaps")) if gaps is not None else types.agg(F.lit(None).cast("array<string>").alias("gaps"))
    both = both.crossJoin(top).crossJoin(known)  # single rows
    both = both.withColumn("gaps", F.when(F.size("gaps") > 0, F.slice("gaps", 1, 2)).otherwise(F.array(F.lit(lx.EVIDENCE_GAP))))
    anchor = F.concat_ws(", ", "method", "disease", "protein", "dataset")
    both = both.withColumn("anchor", F.when(anchor == "", F.col("query")).otherwise(anchor))
    c = {n: F.col(n).isNotNull() for n in ("disease", "method", "protein", "chemical", "dataset", "sentence")}
    pairs = {"disease_method": c["disease"] & c["method"], "protein_chemical": c["protein"] & c["chemical"], "method_dataset": c["method"] & c["dataset"]}
    by_rule = pairs["disease_method"] | pairs["protein_chemical"] | pairs["method_dataset"]
    applies = pairs | {"sentence": c["sentence"] & ~by_rule, "fill": F.lit(True)}
    rules = []
    for i, (rule, conf, novelty, testability, template) in enumerate(lx.HYPOTHESES):
        reasoning, experiments, weakened, insight, excerpt, relevance = lx.HYPOTHESIS_DETAILS[rule]
        own = F.array(item(F.lit(""), F.lit(""), F.coalesce("whole", filled(excerpt)), F.lit(relevance)))
        evidence = own if rule == "sentence" else F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(own)
        times = count if rule == "fill" else 1
        for k in range(times):
            made = F.struct(
                F.lit(100 * i + k).alias("ord"), F.lit(rule).alias("rule"), F.lit(conf).alias("confidence"), F.lit(novelty).alias("novelty"),
                F.lit(testability).alias("testability"), filled(template).alias("hypothesis"), filled(reasoning).alias("reasoning"),
                evidence.alias("supporting_evidence"), F.array(*map(filled, experiments)).alias("suggested_experiments"),
                F.lit(weakened).alias("falsifiable_conditions"), F.col("gaps").alias("research_gaps_addressed"), filled(insight).alias("cross_domain_insight"),
            )
            rules.append(F.when(applies[rule], made))
    rows = both.select(F.explode(F.slice(F.array_compact(F.array(*rules)), 1, count)).alias("h")).select("h.*")
    return ranked(rows)


def meta_insights(types: DataFrame, found: DataFrame, reason: str = "") -> DataFrame:
    """One row: dominant themes, the first hypothesis and its experiments, and why no model was asked."""
    t = dominant_themes(types).agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_type", "theme"))), lambda x: x["theme"]).alias("dominant_themes"))
    first = found.agg(F.min_by("hypothesis", "ord").alias("most_promising_direction"), F.min_by("suggested_experiments", "ord").alias("critical_missing_experiments"))
    return t.crossJoin(first).withColumn("fallback_reason", F.lit(reason))  # single rows


def filled(template: str) -> Column:
    """A template with {column} places."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(piece) if i % 2 else F.lit(piece))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def ranked(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """Hypotheses of more than the least confidence, by confidence times novelty."""
    return rows.where(F.col("confidence") > least).withColumn("score", F.round(F.col("confidence") * F.col("novelty"), 4)).orderBy(F.desc("score"), "ord")


def context_pack(query: str, results: DataFrame, types: DataFrame, gaps: list[str]) -> DataFrame:
    """One row: the text a model is given, of 2200 characters at most."""
    head = F.concat(F.lit('[Paper: "'), F.substring("title", 1, 50), F.lit('" | Section: '), F.col("section"), F.lit(" | Relevance: "), F.format_number("score", 3), F.lit("]\n"), F.substring(clean(F.col("content"), aggressive=True), 1, 350))
    ev = results.where("rank <= 6").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("t")))).alias("e"))
    line = F.concat(F.col("entity_type"), F.lit(": "), F.array_join(F.slice("names", 1, 5), ", "))
    en = types.agg(F.array_sort(F.collect_list(line)).alias("n"))
    gap_lines = ["\n=== RESEARCH GAPS IDENTIFIED ==="] + [f"- {g}" for g in gaps[:5]] if gaps else []
    parts = [
        F.lit(f"RESEARCH QUERY: {query}\n\n=== RETRIEVED EVIDENCE FROM PAPERS ==="),
        F.array_join(F.transform("e", lambda x: x["t"]), "\n"),
        F.when(F.size("n") > 0, F.concat(F.lit("\n=== KEY ENTITIES FOUND ===\n"), F.array_join("n", "\n"))),
        F.lit("\n".join(gap_lines)) if gap_lines else F.lit(None).cast("string"),
    ]
    return ev.crossJoin(en).select(F.substring(F.concat_ws("\n", *parts), 1, 2200).alias("context"))


def contradiction_pairs(papers: DataFrame, topic: str, texts: DataFrame, verdict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row per pair of the papers asked for (paper_id, ord): no text on a side makes it insufficient; the rest goes to the verdict,
    or without one is a model error of low severity. texts: paper_id, text."""
    rows = papers.join(texts, "paper_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    a = rows.select(F.col("paper_id").alias("paper_a_id"), F.col("ord").alias("oa"), F.col("text").alias("text_a"))
    b = rows.select(F.col("paper_id").alias("paper_b_id"), F.col("ord").alias("ob"), F.col("text").alias("text_b"))
    # Pairs of ids first, which are as few as the caller names; the texts join them by key.
    ids = papers.select("paper_id", "ord")
    later = F.broadcast(ids.select(F.col("ord").alias("ob")))
    pairs = ids.select(F.col("ord").alias("oa")).join(later, F.col("oa") < F.col("ob")).join(a, "oa").join(b, "ob")
    lacking = (F.col("text_a") == "") | (F.col("text_b") == "")
    pairs = pairs.withColumn("topic", F.lit(topic)).withColumn("lacking", lacking)
    if verdict is not None:
        return verdict(pairs)
    return pairs.select(
        "paper_a_id", "paper_b_id", "topic", F.lit(False).alias("has_contradiction"), F.lit("LOW").alias("severity"),
        F.when(F.col("lacking"), "insufficient_data").otherwise("model_error").alias("contradiction_type"),
        F.when(F.col("lacking"), lx.INSUFFICIENT).otherwise("").alias("explanation"),
    )


def kept_contradictions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("has_contradiction") & (F.col("severity") != "LOW"))


def discovery_metrics(chunks: Column, entities: Column, relations: Column) -> list[Column]:
    """Novelty, Evidence, Impact, Risk, of 10, to one decimal."""
    ten, one = F.lit(10.0), F.lit(1.0)
    return [
        F.round(F.least(ten, 5 + relations * 0.45), 1).alias("novelty"),
        F.round(F.least(ten, 4 + chunks * 0.8), 1).alias("evidence"),
        F.round(F.least(ten, 5 + entities * 0.18), 1).alias("impact"),
        F.round(F.greatest(one, 8 - chunks * 0.35), 1).alias("risk"),
    ]


def debate(hypotheses: DataFrame, speak: Callable[[str, str, list[dict]], str] | None = None, verdict: Callable[[list[dict]], dict] | None = None, rounds: int = 2) -> DataFrame:
    """Per hypothesis (id, hypothesis, confidence): transcript (agent, round, content), consensus, revised hypothesis, final
    confidence, strengths, concerns, experiments and a summary.

    Without speak a fixed transcript. speak(agent, hypothesis, transcript so far) says a turn: three agents in the first of 1 to 4
    rounds, four in each later one; then verdict(transcript) gives the rest. Models are asked for each hypothesis in turn, so
    hypotheses are few then.
    """
    array = lambda xs: F.array(*map(F.lit, xs))
    if speak is None:
        script = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(r).alias("round"), F.lit(t).alias("content")) for a, r, t in lx.DEBATE_TURNS])
        return hypotheses.select(
            "id", script.alias("transcript"), F.lit("MODERATE_SUPPORT").alias("consensus"), F.col("hypothesis").alias("revised_hypothesis"),
            F.least(F.coalesce("confidence", F.lit(0.5)), F.lit(0.7)).alias("final_confidence"), array(lx.DEBATE_STRENGTHS).alias("key_strengths"),
            array(lx.DEBATE_CONCERNS).alias("key_concerns"), array(lx.DEBATE_EXPERIMENTS).alias("recommended_experiments"), F.lit(lx.DEBATE_SUMMARY).alias("debate_summary"),
        )
    rounds, turn = min(max(rounds, 1), 4), "array<struct<agent:string,round:string,content:string>>"
    texts = ("key_strengths", "key_concerns", "recommended_experiments")
    schema = f"id long, transcript {turn}, consensus string, revised_hypothesis string, final_confidence double, " + ", ".join(f"{t} array<string>" for t in texts) + ", debate_summary string"
    idtype = hypotheses.schema["id"].dataType.simpleString()

    def held(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                said: list[dict] = []
                for k in range(1, rounds + 1):
                    for agent in lx.DEBATE_AGENTS[: 3 if k == 1 else 4]:
                        said.append({"agent": agent, "round": str(k), "content": speak(agent, r["hypothesis"], list(said))})
                v = verdict(said) if verdict is not None else {}
                said.append({"agent": "synthesizer", "round": "final", "content": v.get("debate_summary", "")})
                rows.append({"id": r["id"], "transcript": said, "consensus": v.get("consensus"), "revised_hypothesis": v.get("revised_hypothesis", r["hypothesis"]), "final_confidence": v.get("final_confidence"), **{t: list(v.get(t, [])) for t in texts}, "debate_summary": v.get("debate_summary", "")})
            yield pd.DataFrame(rows, columns=["id", "transcript", "consensus", "revised_hypothesis", "final_confidence", *texts, "debate_summary"])

    return hypotheses.select("id", "hypothesis").mapInPandas(held, schema.replace("id long", f"id {idtype}", 1))


def checked(reply: dict, keys: tuple[str, ...] = lx.REQUIRED_KEYS) -> dict:
    """A model's reply, if it has all keys that its reader needs."""
    if lacking := [k for k in keys if k not in reply]:
        raise ValueError(f"the reply lacks {', '.join(lacking)}")
    return reply


class Model:
    """A language model behind a function that is handed in: generate(prompt) to text. Calls that fail with errors of
    transport are tried again; structured() asks a second time where a reply is no JSON object."""

    def __init__(self, generate: Callable[[str], str], tries: int = 3, wait: float = 1.0, longest: float = 8.0, transient: tuple = (ConnectionError, TimeoutError)):
        self.generate, self.tries, self.wait, self.longest, self.transient = generate, tries, wait, longest, transient

    def __call__(self, prompt: str) -> str:
        for k in range(self.tries):
            try:
                return self.generate(prompt)
            except self.transient:
                if k + 1 == self.tries:
                    raise
                time.sleep(min(self.longest, self.wait * 2**k))
        raise ValueError("a model is tried once at least")

    def structured(self, prompt: str, keys: tuple[str, ...] = ()) -> dict:
        for again in ("", "\n\nReply with the bare JSON object only."):
            text = re.sub(r"```(?:json)?", "", self(prompt + again)).strip()
            for part in (text, text[text.find("{") : text.rfind("}") + 1]):
                try:
                    made = json.loads(part)
                except ValueError:
                    continue
                if isinstance(made, dict):
                    return checked(made, keys)
        raise ValueError("the model gave no JSON object, twice")


def answer(results: DataFrame, sentences: DataFrame, entities: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """One row of the extractive answer: confidence, key finding, methods, targets, evidence and relation lines, and the text."""
    r = results.agg(
        F.count("*").alias("n_results"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "title", "section", "paper_id", "score", first_words(F.col("content"), 42).alias("excerpt")))), 1, 5),
                    lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["title"], F.lit(" ("), x["section"], F.lit(", paper_id="), x["paper_id"].cast("string"), F.lit(", score="), F.format_number(x["score"], 2), F.lit("): "), x["excerpt"])).alias("evidence"),
    )
    s = sentences.agg(F.array_sort(F.collect_list(F.struct((-F.col("sentence_score")).alias("k"), "rank", "place", "sentence"))).alias("s"))
    s = s.select(F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["sentence"]), " ").alias("key_finding"))
    order = Window.orderBy(F.desc("strength"), F.desc("paper_count"), "place")
    top = entities.withColumn("k", F.row_number().over(order)).where("k <= 8")
    names = lambda kinds: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_type").isin(*kinds), F.struct("k", "name")))), lambda x: x["name"]), 1, 4)
    e = top.agg(names(lx.METHOD_TYPES).alias("methods"), names(lx.TARGET_TYPES).alias("targets"))
    fk = Window.orderBy(F.desc("confidence"), F.desc("weight"), "source", "target", "relationship", "paper_id")
    f = facts.withColumn("k", F.row_number().over(fk)).where("k <= 6")
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" --"), F.col("relationship"), F.lit("--> "), F.col("target"), F.lit(" (confidence "), F.format_number("confidence", 2), F.lit(", paper_id="), F.col("paper_id").cast("string"), F.lit(")"))
    g = f.agg(F.count("*").alias("n_relations"), F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]).alias("relations"))
    one = r.crossJoin(s).crossJoin(e).crossJoin(g)  # single rows
    confidence = F.when((F.col("n_results") >= 5) & (F.col("n_relations") > 0), "high").when(F.col("n_results") >= 3, "moderate").otherwise("low")
    one = one.withColumn("confidence", confidence)
    none = lambda c, text: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(text)
    text = F.concat_ws(
        "\n",
        F.lit(lx.KEY_FINDING), F.col("key_finding"), F.lit(""),
        F.lit(lx.STRENGTH), F.concat(F.initcap("confidence"), F.lit(lx.SUPPORT), F.col("n_results").cast("string"), F.lit(lx.CHUNKS_AND), F.col("n_relations").cast("string"), F.lit(lx.RELATIONSHIPS)), F.lit(""),
        F.lit(lx.CONCEPTS), F.concat(F.lit(lx.METHODS_LABEL), none("methods", lx.NO_METHODS)),
        F.concat(F.lit(lx.TARGETS_LABEL), none("targets", lx.NO_TARGETS)), F.lit(""),
        F.lit(lx.BEST), F.array_join("evidence", "\n"), F.lit(""),
        F.lit(lx.GROUNDING), F.when(F.size("relations") > 0, F.array_join("relations", "\n")).otherwise(lx.NO_FACTS),
    )
    empty = F.lit(lx.EMPTY_ANSWER.format(query))
    return one.withColumn("answer", F.when(F.col("n_results") == 0, empty).otherwise(text))
