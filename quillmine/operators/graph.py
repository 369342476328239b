"""Paper and entity graph: candidates, facts, neighbourhoods, bounded paths; plain joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import strength, too_similar, valid_entity
from quillmine.functions.segments import any_of
from quillmine.sources.shelf import kept, new_path

FACT = ("source", "relationship", "target", "confidence", "evidence", "paper_id", "kind")


def candidate_entities(entities: DataFrame, links: DataFrame, terms: list[str], paper_ids: list[int] | None) -> DataFrame:
    """At most 32 entities: by key, then by name, then by mention in the papers; each once, at its first place."""
    key = F.split_part("normalized_name", F.lit(":"), F.lit(2))
    ranked: list[DataFrame] = []
    if terms:
        for i, x in enumerate((key, F.lower("name"))):
            hit = entities.where(any_of(x, [t.lower() for t in terms])).orderBy(F.desc("paper_count"), "id").limit(16)
            order = Window.orderBy(F.desc("paper_count"), "id")
            ranked.append(hit.withColumn("place", F.lit(100 * i) + F.row_number().over(order)))
    if paper_ids:
        near = links.where(F.col("paper_id").isin(*paper_ids)).join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
        near = near.orderBy(F.desc("frequency"), F.desc("paper_count"), "entity_id", "paper_id").limit(24)
        order = Window.orderBy(F.desc("frequency"), F.desc("paper_count"), "entity_id", "paper_id")
        near = near.withColumn("place", F.lit(200) + F.row_number().over(order)).withColumnRenamed("entity_id", "id")
        ranked.append(near.select(*entities.columns, "place"))
    if not ranked:
        return entities.limit(0).withColumn("place", F.lit(0))
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    one = rows.groupBy(*entities.columns).agg(F.min("place").alias("place"))
    return one.orderBy("place").limit(32)


def filtered_entities(found: DataFrame, limit: int = 24) -> DataFrame:
    """Valid names; of one spelling the stronger, then the earlier; strongest and most cited first."""
    s = strength(F.col("name"), F.col("entity_type"))
    rows = found.where(valid_entity(F.col("name"))).withColumn("strength", s)
    best = Window.partitionBy(F.lower("name")).orderBy(F.desc("strength"), "place")
    one = rows.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    return one.orderBy(F.desc("strength"), F.desc("paper_count"), "place").limit(limit)


def explicit_facts(relations: DataFrame, entities: DataFrame, ids: DataFrame, paper_ids: list[int] | None = None, limit: int = 32) -> DataFrame:
    """Relations with an end among ids (one column id), by confidence, with both ends' names.

    The two ends are matched by an equi join each and their union made distinct, so a loop counts once.
    """
    r = relations.where(F.col("paper_id").isin(*paper_ids)) if paper_ids else relations
    at = lambda end: r.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    hit = at("source_entity_id").unionByName(at("target_entity_id")).dropDuplicates(["id"])
    a = entities.select(F.col("id").alias("source_entity_id"), F.col("name").alias("source"))
    top = hit.join(a, "source_entity_id").orderBy(F.desc("confidence"), "id").limit(limit)
    b = entities.select(F.col("id").alias("target_entity_id"), F.col("name").alias("target_name"))
    named = top.join(b, "target_entity_id", "left").withColumn("target", F.coalesce("target_name", F.col("target_entity_id").cast("string")))
    return named.where(valid_entity(F.col("source")) & valid_entity(F.col("target"))).select(
        "source", F.col("relationship_type").alias("relationship"), "target", "confidence", F.lit("").alias("evidence"), "paper_id", F.lit("explicit").alias("kind")
    )


def co_mentions(links: DataFrame, per_paper: int = 8, ahead: int = 3) -> DataFrame:
    """Pairs of entities of a paper: the strongest per_paper, each with the next ahead of it, unless their names are alike.

    links: paper_id, entity_id, name, entity_type, frequency. Ranks within a paper join by an equi join with a range.
    """
    rows = links.where(valid_entity(F.col("name"))).withColumn("s", strength(F.col("name"), F.col("entity_type")))
    order = Window.partitionBy("paper_id").orderBy(F.desc("s"), F.desc("frequency"), "entity_id")
    top = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_paper)
    a = top.select("paper_id", F.col("k").alias("ka"), F.col("name").alias("source"), F.col("frequency").alias("fa"), F.col("s").alias("sa"))
    b = top.select("paper_id", F.col("k").alias("kb"), F.col("name").alias("target"), F.col("frequency").alias("fb"), F.col("s").alias("sb"))
    pairs = a.join(b, "paper_id").where((F.col("kb") > F.col("ka")) & (F.col("kb") <= F.col("ka") + ahead))
    pairs = pairs.where(~too_similar(F.col("source"), F.col("target")))
    key = Window.partitionBy("paper_id", F.least("source", "target"), F.greatest("source", "target")).orderBy("ka", "kb")
    once = pairs.withColumn("n", F.row_number().over(key)).where("n = 1")
    confidence = F.least(F.lit(0.92), 0.35 + (F.col("fa") + F.col("fb")) * 0.035 + F.col("sa") * 0.04 + F.col("sb") * 0.04)
    return once.select(
        "source",
        F.lit("co_mentioned_with").alias("relationship"),
        "target",
        confidence.alias("confidence"),
        F.concat(F.lit(lx.CO_MENTION_EVIDENCE), F.col("paper_id").cast("string"), F.lit(".")).alias("evidence"),
        "paper_id",
        F.lit("co_mention").alias("kind"),
    )


def merged_facts(first: DataFrame, second: DataFrame, limit: int = 32) -> DataFrame:
    """Facts of both; of one source, relation, target and paper the more confident, the first on a tie."""
    both = first.select(*FACT, F.lit(0).alias("src")).unionByName(second.select(*FACT, F.lit(1).alias("src")))
    best = Window.partitionBy("source", "relationship", "target", "paper_id").orderBy(F.desc("confidence"), "src")
    one = both.withColumn("k", F.row_number().over(best)).where("k = 1")
    return one.orderBy(F.desc("confidence"), "src", "source", "target", "relationship", "paper_id").limit(limit).select(*FACT)


def filtered_facts(facts: DataFrame, limit: int = 32) -> DataFrame:
    ok = valid_entity(F.col("source")) & valid_entity(F.col("target")) & ~too_similar(F.col("source"), F.col("target"))
    weight = strength(F.col("source")) + strength(F.col("target"))
    rows = facts.where(ok).withColumn("weight", weight)
    return rows.orderBy(F.desc("confidence"), F.desc("weight"), "source", "target", "relationship", "paper_id").limit(limit)


def paper_graph(paper: DataFrame, entities: DataFrame, links: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around one paper (a row of papers): 80 entities, their mentions, 100 relations among them."""
    pid = paper.select(F.col("id").alias("paper_id"), "title")
    near = links.join(F.broadcast(pid), "paper_id").join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    near = near.orderBy(F.desc("frequency"), "name", "entity_id").limit(80)
    node = lambda c: F.concat(F.lit("entity-"), F.col(c).cast("string"))
    of_paper = F.concat(F.lit("paper-"), F.col("paper_id").cast("string"))
    nodes = pid.select(of_paper.alias("id"), F.col("title").alias("label"), F.lit("Paper").alias("type"), F.lit(None).cast("int").alias("mention_count"), F.lit(1).alias("paper_count")).unionByName(
        near.select(node("entity_id").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), F.col("frequency").alias("mention_count"), "paper_count")
    )
    ids = near.select("entity_id")
    inside = relations.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(
        ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi"
    )
    inside = inside.orderBy(F.desc("confidence"), "id").limit(100)
    edges = near.select(of_paper.alias("source"), node("entity_id").alias("target"), F.lit("MENTIONS").alias("type"), F.lit(None).cast("double").alias("confidence"), "paper_id").unionByName(
        inside.select(node("source_entity_id").alias("source"), node("target_entity_id").alias("target"), F.col("relationship_type").alias("type"), "confidence", "paper_id")
    )
    return nodes, edges


def entity_graph(name: str, papers: DataFrame, entities: DataFrame, links: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the entities that a name is, or is part of: 8 seeds, 24 of their papers, 40 relation ends,
    48 entities of the papers. Where a node is found twice, the later finding's number of mentions stands."""
    plain = " ".join(name.lower().split())
    seeds = entities.where((F.lower("name") == plain) | F.lower("name").contains(name.lower())).orderBy(F.desc("paper_count"), "name", "id").limit(8)
    sid = seeds.select(F.col("id").alias("entity_id"))
    of_papers = papers.select(F.col("id").alias("paper_id"), "title", "publication_year")
    mention = links.join(sid, "entity_id", "left_semi").join(of_papers, "paper_id").orderBy(F.desc("frequency"), "title", "paper_id", "entity_id").limit(24)
    ends = [("source_entity_id", "target_entity_id"), ("target_entity_id", "source_entity_id")]
    around = [
        relations.join(sid.withColumnRenamed("entity_id", here), here, "left_semi").withColumn("entity_id", F.col(there)) for here, there in ends
    ]
    rel = around[0].unionByName(around[1]).join(sid, "entity_id", "left_anti").dropDuplicates(["id", "entity_id"])
    rel = rel.join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type", "paper_count"), "entity_id").orderBy(F.desc("confidence"), "id", "entity_id").limit(40)
    pid = mention.select("paper_id").distinct()
    co = links.join(pid, "paper_id", "left_semi").join(sid, "entity_id", "left_anti")
    co = co.join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type", "paper_count"), "entity_id")
    co = co.orderBy(F.desc("frequency"), F.desc("paper_count"), "entity_id", "paper_id").limit(48)
    en = F.concat(F.lit("entity-"), F.col("entity_id").cast("string"))
    pn = F.concat(F.lit("paper-"), F.col("paper_id").cast("string"))
    node = lambda df, wave, count: df.select(en.alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), count.alias("mention_count"), "paper_count", F.lit(wave).alias("wave"))
    found = node(seeds.withColumnRenamed("id", "entity_id"), 0, F.lit(0)).unionByName(node(rel, 1, F.lit(0))).unionByName(node(co, 2, F.col("frequency")))
    nodes = found.groupBy("id", "label", "type", "paper_count").agg(F.max_by("mention_count", F.struct("wave", -F.col("mention_count"))).alias("mention_count"))
    nodes = nodes.unionByName(
        mention.select(pn.alias("id"), F.col("title").alias("label"), F.lit("Paper").alias("type"), F.lit(1).alias("paper_count"), F.lit(None).cast("int").alias("mention_count")).distinct()
    )
    says = lambda df: df.select(pn.alias("source"), en.alias("target"), F.lit("MENTIONS").alias("type"), F.lit(None).cast("double").alias("confidence"), "paper_id")
    links_ = rel.select(
        F.concat(F.lit("entity-"), F.col("source_entity_id").cast("string")).alias("source"),
        F.concat(F.lit("entity-"), F.col("target_entity_id").cast("string")).alias("target"),
        F.col("relationship_type").alias("type"),
        "confidence",
        "paper_id",
    )
    return nodes, says(mention).unionByName(links_).unionByName(says(co))


def undirected(relations: DataFrame) -> DataFrame:
    """edge_id, u, v, paper_id, in both directions; a loop once."""
    e = relations.select(F.col("id").alias("edge_id"), F.col("source_entity_id").alias("u"), F.col("target_entity_id").alias("v"), "paper_id")
    return e.unionByName(e.where("u <> v").select("edge_id", F.col("v").alias("u"), F.col("u").alias("v"), "paper_id"))


def _levels(relations: DataFrame, start: list[int], hops: int) -> list[DataFrame]:
    """Trails of 1 to hops relations from the start entities, by their number: nodes, edges, papers. No relation comes twice.

    Each hop is one equi join on the trail's end; the depth is bounded.
    """
    edges = undirected(relations)
    ids = relations.sparkSession.createDataFrame([(int(i),) for i in sorted(set(start))], "u long")  # what the caller names
    first = edges.join(ids, "u", "left_semi").select(F.array("u", "v").alias("nodes"), F.array("edge_id").alias("edges"), F.array("paper_id").alias("papers"))
    out = [first]
    end = edges.select(F.col("u").alias("end"), "edge_id", "v", "paper_id")
    for _ in range(2, hops + 1):
        out.append(_grown(out[-1], end))
    return out


def trails(relations: DataFrame, start: list[int], hops: int) -> DataFrame:
    """All trails of 1 to hops relations from the start entities: nodes, edges, papers, hops."""
    levels = _levels(relations, start, hops)
    out = levels[0].withColumn("hops", F.lit(1))
    for h in range(2, hops + 1):
        out = out.unionByName(levels[h - 1].withColumn("hops", F.lit(h)))
    return out


def _grown(prefixes: DataFrame, end: DataFrame) -> DataFrame:
    """Trails with one relation more, which they don't hold yet."""
    grown = prefixes.withColumn("end", F.element_at("nodes", -1)).join(end, "end").where(~F.array_contains("edges", F.col("edge_id")))
    return grown.select(*[F.concat(c, F.array(x)).alias(c) for c, x in (("nodes", "v"), ("edges", "edge_id"), ("papers", "paper_id"))])


#: Trails that pass through the driver at once, at most; more are written to a table.
AT_HAND = 10_000


def _least(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(The first `most` trails by their relations and nodes, whether there are more)."""
    first = rows.orderBy("edges", "nodes").limit(most + 1)
    if most < AT_HAND:
        got = first.collect()
        few = rows.sparkSession.createDataFrame(got[:most], rows.schema)
        return F.broadcast(few), len(got) > most
    written = kept(first, new_path(rows.sparkSession, "trails"))
    more = written.count() > most
    return (written.orderBy("edges", "nodes").limit(most) if more else written), more


def _first_trails(edges: DataFrame, ids: DataFrame, toward: list[DataFrame | None], limit: int) -> DataFrame:
    """The first `limit` trails of len(toward) relations from ids, by their relations; toward[i] (one column, end) has the nodes
    that the i-th relation may lead to, None any.

    Only the least trails of each length go on: whatever extends a greater one is greater itself. A hub so costs a row for each of
    its relations, not for each pair of them. If trails that were left may be needed, as too many of those kept came to nothing, many
    more are kept; at last all.
    """
    end = edges.select(F.col("u").alias("end"), "edge_id", "v", "paper_id")
    width = 32 * limit
    while True:
        rows, left = None, False
        for i, goal in enumerate(toward):
            if rows is None:
                rows = edges.join(ids, "u", "left_semi").select(F.array("u", "v").alias("nodes"), F.array("edge_id").alias("edges"), F.array("paper_id").alias("papers"))
            else:
                rows = _grown(rows, end)
            if goal is not None:
                rows = rows.join(goal, F.element_at("nodes", -1) == goal["end"], "left_semi")
            rows, more = _least(rows, limit if i == len(toward) - 1 else width)
            left |= more and i < len(toward) - 1
        if not left or rows.count() >= limit:
            return rows
        width *= 16


def _by_hops(edges: DataFrame, ids: DataFrame, goals: list[list[DataFrame | None]], limit: int) -> DataFrame:
    """Up to limit trails, shorter ones first; goals has a list for each number of hops. Longer ones are looked for only while there are too few."""
    spark, rows = edges.sparkSession, []
    columns = edges.select(F.array("u").alias("nodes"), F.array("edge_id").alias("edges"), F.array("paper_id").alias("papers"), F.lit(1).alias("hops")).schema
    for h, toward in enumerate(goals, 1):
        if len(rows) < limit:
            rows += _first_trails(edges, ids, toward, limit - len(rows)).withColumn("hops", F.lit(h)).collect()  # limit rows at most
    return spark.createDataFrame(rows, columns).orderBy("hops", "edges", "nodes")


def neighbourhood(relations: DataFrame, start: list[int], hops: int = 2, limit: int = 100) -> DataFrame:
    """Up to limit trails around the start, shortest first, as distinct edges. Runs bounded jobs while it is built."""
    edges = kept(undirected(relations), new_path(relations.sparkSession, "edges"))
    ids = F.broadcast(relations.sparkSession.createDataFrame([(int(i),) for i in sorted(set(start))], "u long"))  # what the caller names
    found = _by_hops(edges, ids, [[None] * h for h in range(1, hops + 1)], limit)
    return F.broadcast(found.select(F.explode("edges").alias("id")).distinct()).join(relations, "id")


def paths_between(relations: DataFrame, a: list[int], b: list[int], hops: int = 4, limit: int = 20) -> DataFrame:
    """Up to limit trails from a to b, shortest first: nodes, edges, papers, hops. Runs bounded jobs while it is built.

    First, sets of nodes: those from which b can be reached in 1, 2, ... relations, by joins and distinct. Then trails are spelled out
    from a through these sets alone, so none that can't arrive in the hops left is begun.
    """
    spark = relations.sparkSession
    if not a or not b:
        return trails(relations, a or [-1], 1).limit(0)
    edges = kept(undirected(relations), new_path(spark, "edges"))
    named = lambda xs, c: F.broadcast(spark.createDataFrame([(int(i),) for i in sorted(set(xs))], f"{c} long"))
    reach = [named(b, "end")]
    for _ in range(1, hops):
        back = edges.select("u", F.col("v").alias("end")).join(reach[-1], "end", "left_semi").select(F.col("u").alias("end")).distinct()
        reach.append(kept(back, new_path(spark, "reach")))
    return _by_hops(edges, named(a, "u"), [reach[:h][::-1] for h in range(1, hops + 1)], limit)


def topic_papers(papers: DataFrame, entities: DataFrame, links: DataFrame, topic: str) -> DataFrame:
    """Papers that mention an entity with the topic in its name; once for each such entity."""
    hit = entities.where(F.lower("name").contains(topic.lower())).select(F.col("id").alias("entity_id"))
    named = papers.select(F.col("id").alias("paper_id"), "title", F.col("publication_year").alias("year"))
    return links.join(hit, "entity_id").join(named, "paper_id").select("paper_id", "title", "year", "entity_id")


def graph_export(entities: DataFrame, relations: DataFrame, limit: int = 500, links: DataFrame | None = None, paper_ids: list[int] | None = None) -> DataFrame:
    """Entities, each with its relations or alone; with papers, those entities that they mention."""
    base = entities.select(F.col("id").alias("entity_id"), "name")
    if paper_ids:
        base = links.where(F.col("paper_id").isin(*paper_ids)).select("entity_id", F.col("paper_id").alias("mention_paper_id")).join(base, "entity_id")
    either = undirected(relations).select(F.col("u").alias("entity_id"), F.col("v").alias("other_id"), "edge_id", "paper_id")
    return base.join(either, "entity_id", "left").orderBy("entity_id", "edge_id", "other_id").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges per node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def palette(kind: Column) -> Column:
    """The first key of the palette in a node's type, else entity."""
    low, out = F.lower(F.coalesce(kind, F.lit("entity"))), F.lit("entity")
    for k in reversed(lx.PALETTE):
        out = F.when(low.contains(k), k).otherwise(out)
    return out


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The node and those one edge away."""
    return incident(edges, node).select(F.explode(F.array("source", "target")).alias("node")).distinct()


def labelled(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes (id, label) whose label, or id where there is none, holds the text in either case; all of them for a blank text."""
    if not text.strip():
        return nodes
    shown = F.coalesce(F.nullif("label", F.lit("")), F.col("id").cast("string"))
    return nodes.where(F.lower(shown).contains(text.lower()))


def fact_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts (with ord from 0) between nodes (id, label, ord from 0): ends by label, the later node of a label; an end that no
    label names goes to the node in its turn."""
    by_label = nodes.groupBy(F.lower("label").alias("key")).agg(F.max_by("id", "ord").alias("id"))
    n = nodes.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    turn = nodes.select("ord", "id")
    rows = facts.join(F.broadcast(n)).withColumn("t0", F.col("ord") % F.col("n")).withColumn("t1", (F.col("ord") + 1) % F.col("n"))
    for end, t in (("source", "t0"), ("target", "t1")):
        named = by_label.select(F.col("key"), F.col("id").alias(f"{end}_named"))
        rows = rows.join(named, F.lower(end) == F.col("key"), "left").drop("key")
        rows = rows.join(turn.select(F.col("ord").alias(t), F.col("id").alias(f"{end}_turn")), t, "left")
        rows = rows.withColumn(f"{end}_id", F.coalesce(f"{end}_named", f"{end}_turn"))
    conf = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.55))
    return rows.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship").alias("type"), conf.alias("confidence"))
