"""The n best chunks of all, without reading all: postings in blocks of falling importance, blocks and texts left out by bounds."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions.scores import bm25, hybrid, lexical, terms_of, tokens
from quillmine.functions.text import word_count
from quillmine.sources.shelf import kept, new_path

#: Chunks of a block, folders of postings by a token's hash.
BLOCK, SHELVES = 1024, 64
#: Half of what rounding a score to four digits may add.
HALF = 5e-5


@dataclass
class Impacts:
    """A written index: postings (shelf, token, block, id, tf, length, importance) and their maxima per token and block."""

    path: str
    spark: SparkSession
    mean: float
    blocks: int
    schemas: tuple

    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.schemas[0]).parquet(f"{self.path}/postings")

    def maxima(self) -> DataFrame:
        return self.spark.read.schema(self.schemas[1]).parquet(f"{self.path}/maxima")


@dataclass
class Report:
    """Blocks that hold a query term, blocks whose postings were read, and texts that were fetched."""

    blocks: int = 0
    read: int = 0
    texts: int = 0


def _shelf(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SHELVES)).cast("int")


def _counted(toks: str) -> Column:
    """(token, tf) for each different token: of the sorted tokens, where a run of equal ones begins and how far the next is."""

    def runs(ts: Column) -> Column:
        first = F.filter(F.transform(ts, lambda t, i: F.when((i == 0) | (t != F.get(ts, i - 1)), F.struct(t.alias("token"), i.alias("at")))), lambda x: x.isNotNull())
        gap = lambda fs: F.transform(fs, lambda x, k: F.struct(x["token"].alias("token"), (F.coalesce(F.get(fs, k + 1)["at"], F.size(ts)) - x["at"]).cast("long").alias("tf")))
        return F.get(F.transform(F.array(first), gap), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(toks)), runs), F.lit(0))


def build(chunks: DataFrame, path: str | None = None, block: int = BLOCK) -> Impacts:
    """Writes postings of all chunks (id, content, importance_score).

    Chunks are range-sorted by falling importance and cut into blocks of so many, so the first blocks hold the best. A token's
    postings in a block are a run of rows; its greatest frequency, least length and greatest importance there bound every score.
    """
    spark, path = chunks.sparkSession, path or new_path(chunks.sparkSession, "impacts")
    mean = chunks.agg(F.avg(word_count(F.col("content")).cast("double"))).first()[0] or 0.0
    toks = tokens(F.coalesce(F.col("content"), F.lit("")))
    # Written first: sorting by range reads its rows twice, and would take the texts apart twice.
    rows = kept(chunks.select("id", F.coalesce("importance_score", F.lit(0.0)).alias("importance"), toks.alias("toks")), f"{path}/tokens")
    # Impact order, over all chunks: a number of the partition and a row in it make a block.
    rows = rows.repartitionByRange(F.desc("importance"), "id").sortWithinPartitions(F.desc("importance"), "id").withColumn("at", F.monotonically_increasing_id())
    place = F.shiftleft(F.shiftright("at", 33), 24) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / block).cast("long")
    stored = kept(rows.withColumn("block", place).drop("at"), f"{path}/chunks")
    each = stored.select("id", "block", "importance", F.size("toks").alias("length"), F.explode(_counted("toks")).alias("x"))
    counted = each.select("x.token", "block", "id", "length", "importance", "x.tf").withColumn("shelf", _shelf(F.col("token")))
    posted = kept(counted.hint("rebalance", "shelf").sortWithinPartitions("shelf", "token", "block", "id"), f"{path}/postings", ["shelf"])
    best = posted.groupBy("shelf", "token", "block").agg(F.max("tf").alias("tf"), F.min("length").alias("length"), F.max("importance").alias("importance"))
    most = kept(best.hint("rebalance", "shelf").sortWithinPartitions("shelf", "token", "block"), f"{path}/maxima", ["shelf"])
    return Impacts(path, spark, mean, stored.select("block").distinct().count(), (posted.schema, most.schema))


def _bound(index: Impacts, rows: DataFrame, by: list[str], terms: Counter) -> DataFrame:
    """by and high: the greatest score that rows (token, tf, length, importance) of one `by` allow; every text may match the terms fully."""
    length = F.greatest(F.col("length"), F.lit(1)) / F.lit(max(index.mean, 1.0))
    share = F.col("tf") * (lx.K1 + 1) / (F.col("tf") + lx.K1 * (1 - lx.B + lx.B * length))
    times = F.create_map(*[x for t, k in terms.items() for x in (F.lit(t), F.lit(float(k)))])
    # A text has terms in an order of its own, so sums of the same numbers may differ in the last digit.
    sums = rows.groupBy(*by).agg(F.sum(share * times[F.col("token")]).alias("bm"), F.max("importance").alias("importance"))
    n = float(sum(terms.values()))
    return sums.select(*by, (0.45 * F.least(F.col("bm") / n, F.lit(1.0)) + 0.40 * F.col("importance") + 0.15 + 1e-9).alias("high"))


def _scored(index: Impacts, chunks: DataFrame, ids: DataFrame, found: list[str], n: int) -> DataFrame:
    """The n best of the chunks that ids names, with score, as an exhaustive search scores them."""
    terms = F.array(*map(F.lit, found))
    rows = chunks.join(ids.select("id"), "id", "left_semi").withColumn("bm25", bm25(terms, tokens(F.col("content")), F.lit(index.mean)))
    score = hybrid(F.col("bm25"), terms, F.col("importance_score"), lexical(terms, F.col("content")))
    return rows.where("bm25 > 0").withColumn("score", score).orderBy(F.desc("score"), F.desc("importance_score"), "id").limit(n)


def search(index: Impacts, chunks: DataFrame, query: str, n: int, first: int = 4) -> tuple[DataFrame, Report]:
    """(the n best of all chunks by hybrid score, what was read). Scores, filters and order are those of lexical_search, over all chunks
    instead of the most important ones; the mean length is that of all.

    The `first` blocks of the greatest bounds are looked at, and their best texts scored: the n-th score is the threshold. Then
    only blocks, and in them only texts, whose bound reaches it are read. Ids go first, texts are fetched for what is left.
    """
    found = terms_of(query)
    if not found:
        raise ValueError("the query has no term to look up; lexical_search takes the most important chunks then")
    terms = Counter(found)
    shelves = {r[0] for r in index.spark.createDataFrame([(t,) for t in terms], "t string").select(_shelf(F.col("t"))).collect()}  # a row per term
    here = (F.col("shelf").isin(*shelves)) & F.col("token").isin(*terms)
    blocks = kept(_bound(index, index.maxima().where(here), ["block"], terms), new_path(index.spark, "bounds"))
    best = [r["block"] for r in blocks.orderBy(F.desc("high"), "block").limit(first).collect()]
    posted = index.postings().where(here)
    ids = kept(_bound(index, posted.where(F.col("block").isin(*best)), ["id"], terms).orderBy(F.desc("high"), "id").limit(4 * n), new_path(index.spark, "ids"))
    leading = [r["score"] for r in _scored(index, chunks, F.broadcast(ids), found, n).select("score").collect()]  # n numbers
    floor = leading[-1] - HALF if len(leading) == n else float("-inf")
    wanted = blocks.where(F.col("high") >= floor).select("block")
    rows = _bound(index, posted.join(wanted, "block", "left_semi"), ["id"], terms)
    left = kept(rows.where(F.col("high") >= floor), new_path(index.spark, "ids"))
    report = Report(blocks.count(), wanted.count(), left.count())
    return _scored(index, chunks, left, found, n), report
