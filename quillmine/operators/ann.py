"""A vector index: inverted file by distributed k-means, product-quantised codes with error bounds, exact scores for what is left.

A search scores a few rows of the nearest cells, whose n-th score is a floor for what follows. It then reads codes (an eighth of the
vectors' bytes) of more cells and whole vectors only of rows that the floor and the codes' error bounds can't rule out. These cells are a
number of probes (recall by that number) or all that their radius can't rule out; then it returns what a scan of all vectors does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.functions.scores import dot
from quillmine.sources.shelf import dealt, kept, new_path

#: Rows that k-means and code books are fitted on, at most; every row is indexed, whatever these are.
FIT_ROWS = 65_536
#: Vectors of a block of codes, queries of a pack, code words of a book.
BLOCK, PACK, WORDS = 1024, 256, 256
#: Cells that a query's floor is taken from, at most; rows of them that are scored for it, for each row asked for.
START, TRIED = 8, 2
#: Values that a map works on, or sends, at a time, about.
AT_ONCE = 1 << 21
#: What is added to bounds for rounding, per unit of the query's length.
SLACK = 1e-6

ROW = "paper_id long, workspace_id string, section string, embedding array<float>, cell int, code binary, error float, off double"
BLOCKS = "workspace_id string, cell int, paper_ids array<long>, keys array<long>, sections array<string>, codes binary, errors array<float>"
QUERIES = "workspace_id string, cell int, source_ids array<long>, floors array<double>, q array<float>"
HITS = "source_id long, cell int, key long, paper_id long, low double, high double"


@dataclass
class Index:
    """A written index. centres: a row per cell; books: (parts, words, dims / parts); radius: of each cell, below 0 if it is empty."""

    path: str
    centres: np.ndarray
    books: np.ndarray
    radius: np.ndarray
    rows: int
    spark: SparkSession

    def vectors(self) -> DataFrame:
        """All rows with key and embedding, in folders by cell."""
        return self.spark.read.schema(f"{ROW}, key long").parquet(f"{self.path}/rows")

    def blocks(self) -> DataFrame:
        """Codes of up to BLOCK rows of one cell and workspace a row, in folders by cell."""
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), values.ravel())


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches, cut so that width values for each row are AT_ONCE values or less. What a map holds doesn't grow with cells and queries then."""
    step = max(1, AT_ONCE // width)
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centre, the first of equals."""
    return (np.einsum("ij,ij->i", centres, centres)[None] - 2 * x @ centres.T).argmin(axis=1)


def _parted(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def _words_of(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Number of the nearest code word for each part of each row."""
    split = _parted(residual, len(books))
    return np.stack([_nearest(split[:, j], b) for j, b in enumerate(books)], axis=1)


def _decoded(words: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([b[words[:, j]] for j, b in enumerate(books)], axis=1)


def _means(sample: DataFrame, members: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], old: np.ndarray) -> np.ndarray:
    """A round of k-means: members gives (group, row) for the sample's vectors; each group's mean, or its old centre if it is empty.

    Every task sums its own rows and sends a row per group; the driver gets a row per group.
    """
    groups, width = old.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(groups, np.int64), np.zeros((groups, width))
        for b in _slices(batches, groups):
            group, x = members(_matrix(b.column("embedding"), b.num_rows))
            n += np.bincount(group, minlength=groups)
            np.add.at(total, group, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), _lists(total[some])], ["g", "n", "total"])

    parts = sample.select("embedding").mapInArrow(sums, "g long, n long, total array<double>")
    each = parts.groupBy("g").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    new = old.copy()
    for r in each.collect():
        new[r["g"]] = np.array(r["total"]) / r["n"]
    return new


def _encoder(centres: np.ndarray, books: np.ndarray):
    """A map of Arrow batches that adds cell, code, an upper bound of the code's error, and the distance from the cell's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, max(len(centres), books.shape[1])):
            x = _matrix(b.column("embedding"), b.num_rows)
            cell = _nearest(x, centres)
            residual = x - centres[cell]
            words = _words_of(residual, books)
            error = np.nextafter((np.linalg.norm(residual - _decoded(words, books), axis=1) * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))
            codes = [w.tobytes() for w in words.astype(np.uint8)]
            added = [pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary()), pa.array(error), pa.array(np.linalg.norm(residual, axis=1))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("paper_id", "workspace_id", "section", "embedding")), *added], [f.split()[0] for f in ROW.split(", ")])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to size rows of one workspace and cell, from rows sorted by these; batches are joined across their ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell, space = b.column("cell").to_numpy(), b.column("workspace_id").to_pylist()
        cuts = [0, *(i for i in range(1, b.num_rows) if cell[i] != cell[i - 1] or space[i] != space[i - 1]), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (held[0].column("cell")[0], held[0].column("workspace_id")[0]) != (b.column("cell")[lo], b.column("workspace_id")[lo]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            while lo < hi:
                take = min(hi - lo, size - sum(x.num_rows for x in held))
                held.append(b.slice(lo, take))
                lo += take
                if sum(x.num_rows for x in held) == size:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _one(column: pa.Array) -> pa.Array:
    """All values of a column as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _gathered(batches, BLOCK):
        codes = pa.array([b"".join(g.column("code").to_pylist())], pa.binary())
        columns = [g.column("workspace_id")[:1], g.column("cell")[:1], *(_one(g.column(c)) for c in ("paper_id", "key", "section")), codes, _one(g.column("error"))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _gathered(batches, PACK):
        columns = [g.column("workspace_id")[:1], g.column("cell")[:1], _one(g.column("source_id")), _one(g.column("floor")), _one(g.column("q").flatten())]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in QUERIES.split(", ")])


def _packed(rows: DataFrame, pack, schema: str) -> DataFrame:
    """Rows of one workspace and cell brought together and packed. The exchange may be split where a cell is hot, as packs are bounded."""
    return rows.hint("rebalance", "workspace_id", "cell").sortWithinPartitions("cell", "workspace_id").mapInArrow(pack, schema)


def _usable(embedding: Column, dims: int) -> Column:
    return (F.size(embedding) == dims) & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def build(vectors: DataFrame, dims: int, path: str | None = None, cells: int | None = None, rounds: int = 5, fit_rows: int = FIT_ROWS) -> Index:
    """Writes an index of vectors (paper_id, workspace_id, section, embedding).

    cells: number of k-means cells, by default half the root of the number of rows, 4096 at most. Centres and code books (two
    dimensions a part, one byte a part) are fitted on up to fit_rows rows of the least hash of paper_id; all rows are assigned,
    encoded and written. Vectors that are null, of another length, or not finite are left out, as no score is defined for them.
    """
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-index")
    rows = vectors.select(F.col("paper_id").cast("long").alias("paper_id"), "workspace_id", F.col("section"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(_usable(F.col("embedding"), dims))
    n = rows.count()
    hashed = F.xxhash64("paper_id", F.lit(11))
    few = rows if n <= 2 * fit_rows else rows.where(hashed <= -(1 << 63) + (1 << 64) * 2 * fit_rows // n)
    sample = kept(few.orderBy(hashed, "paper_id", "embedding").limit(fit_rows), f"{path}/sample")
    cells = min(cells or max(1, min(4096, round(n**0.5 / 2))), max(n, 1))
    first = sample.orderBy(hashed, "paper_id", "embedding").limit(max(WORDS, cells)).collect()
    seeds = np.array([r["embedding"] for r in first], dtype=np.float64).reshape(-1, dims)
    centres = seeds[:cells] if n else np.zeros((1, dims))
    for _ in range(rounds if n else 0):
        centres = _means(sample, lambda x, c=centres: (_nearest(x, c), x), centres)
    width = 2 if dims % 2 == 0 else 1
    parts = dims // width
    residual = seeds - centres[_nearest(seeds, centres)] if n else np.zeros((1, dims))
    books = _parted(residual[:WORDS], parts).transpose(1, 0, 2).copy()
    words = books.shape[1]

    def members(x: np.ndarray, c: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - c[_nearest(x, c)]
        group = _words_of(rest, books) + np.arange(parts)[None] * words
        return group.ravel(), _parted(rest, parts).reshape(-1, width)

    for _ in range(rounds if n else 0):
        books = _means(sample, lambda x, b=books: members(x, centres, b), books.reshape(-1, width)).reshape(books.shape)
    written = kept(rows.mapInArrow(_encoder(centres, books), ROW).withColumn("key", F.monotonically_increasing_id()), f"{path}/rows", ["cell"])
    packed = _packed(written.select("workspace_id", "cell", "paper_id", "key", "section", "code", "error"), _blocks, BLOCKS)
    kept(packed, f"{path}/blocks", ["cell"])
    radius = np.full(len(centres), -1.0)
    for r in written.groupBy("cell").agg(F.max("off").alias("off")).collect():  # a row per cell
        radius[r["cell"]] = r["off"] * (1 + 1e-9) + 1e-12
    return Index(path, centres, books, radius, n, spark)


def _probes(index: Index, probes: int | None):
    """A map of queries (source_id, workspace_id, q, floor) to a row for each cell that they go to.

    With probes, only the cells of the greatest scores of their centres. Cells whose best possible score, of the centre plus radius, doesn't
    reach the floor are left out.
    """
    centres, radius = index.centres, index.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, centres.size):  # a row with the query's vector for each cell
            q = _matrix(b.column("q"), b.num_rows)
            score = np.where(radius >= 0, q @ centres.T, -np.inf)
            length, floor = np.linalg.norm(q, axis=1)[:, None], b.column("floor").to_numpy()[:, None]
            wanted = (radius >= 0) & (score + length * (radius + SLACK) >= floor)
            if probes is not None:
                place = np.empty(score.shape, dtype=np.int64)
                np.put_along_axis(place, np.argsort(-score, axis=1, kind="stable"), np.arange(len(centres))[None], axis=1)
                wanted &= place < probes
            at, cell = np.nonzero(wanted)
            out = pa.RecordBatch.from_arrays([b.column(c) for c in ("source_id", "workspace_id", "q", "floor")], ["source_id", "workspace_id", "q", "floor"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], ["source_id", "workspace_id", "q", "floor", "cell"])

    return run


def _scan(index: Index, n: int, section: str | None, exclude: tuple[int, ...], few: bool = False):
    """A map of packs of queries, each beside a block of codes, to the rows that may be among a query's n best; with few, to n rows of a block.

    A code gives a score within its error times the query's length. A row goes on if the upper end reaches the query's floor and
    the n-th best lower end of the block; with few, if its lower end is one of the n best.
    """
    centres, books, parts = index.centres, index.books, len(index.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = lambda c, b=b, i=i: b.column(c)[i].values
                papers, sources, floors = at("paper_ids").to_numpy(), at("source_ids").to_numpy(), at("floors").to_numpy()
                words = np.frombuffer(b.column("codes")[i].as_buffer(), dtype=np.uint8).reshape(len(papers), parts)
                cell = b.column("cell")[i].as_py()
                q = at("q").to_numpy().reshape(len(sources), -1).astype(np.float64)
                score = q @ (centres[cell] + _decoded(words, books)).T
                wide = np.linalg.norm(q, axis=1)[:, None] * (at("errors").to_numpy().astype(np.float64)[None] + SLACK)
                ok = (papers[None] != sources[:, None]) & ~np.isin(papers, exclude)[None]
                if section is not None:
                    ok &= np.array([s == section for s in at("sections").to_pylist()])[None]
                low, high = np.where(ok, score - wide, -np.inf), np.where(ok, score + wide, -np.inf)
                if few and low.shape[1] > n:
                    v = np.argpartition(low, -n, axis=1)[:, -n:]
                    s, v = np.repeat(np.arange(len(q)), n), v.ravel()
                    s, v = s[ok[s, v]], v[ok[s, v]]
                else:
                    best = np.partition(low, -n, axis=1)[:, -n] if low.shape[1] > n else np.full(len(q), -np.inf)
                    s, v = np.nonzero(ok & (high >= np.maximum(best, floors)[:, None]))
                columns = [pa.array(sources[s]), pa.array(np.full(len(s), cell, np.int32)), pa.array(at("keys").to_numpy()[v]), pa.array(papers[v]), pa.array(low[s, v]), pa.array(high[s, v])]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in HITS.split(", ")])

    return run


def _pairs(index: Index, queries: DataFrame, probes: int | None) -> DataFrame:
    """Packs of queries, each beside a block of codes of a cell that they go to. Spark would take the packs for as few bytes as the queries, so
    the join is told to sort both sides and not to broadcast one."""
    spread = dealt(queries).mapInArrow(_probes(index, probes), "source_id long, workspace_id string, q array<float>, floor double, cell int")
    return _packed(spread, _packs, QUERIES).join(index.blocks().hint("merge"), ["workspace_id", "cell"])


def _tried(index: Index, queries: DataFrame, probes: int, n: int, section: str | None, exclude: tuple[int, ...]) -> DataFrame:
    """Of the nearest cells, the n rows of the best lower ends for each query."""
    found = _pairs(index, queries, probes).mapInArrow(_scan(index, n, section, exclude, few=True), HITS)
    best = Window.partitionBy("source_id").orderBy(F.desc("low"), "cell", "key")
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= n).select("source_id", "cell", "key", "paper_id")


def _candidates(index: Index, queries: DataFrame, probes: int | None, n: int, section: str | None, exclude: tuple[int, ...]) -> DataFrame:
    """Rows that may be among the n best of the queries in the cells they go to."""
    found = _pairs(index, queries, probes).mapInArrow(_scan(index, n, section, exclude), HITS)
    # The n-th best lower end over all of a query's blocks.
    last = Window.partitionBy("source_id").orderBy(F.desc("low"), "key")
    nth = F.max(F.when(F.col("k") == n, F.col("low"))).over(Window.partitionBy("source_id"))
    kept_on = found.withColumn("k", F.row_number().over(last)).withColumn("nth", nth).where(F.col("nth").isNull() | (F.col("high") >= F.col("nth")))
    return kept_on.select("source_id", "cell", "key", "paper_id")


def _exact(index: Index, found: DataFrame, queries: DataFrame) -> DataFrame:
    """source_id, paper_id, score: found rows meet their vectors by cell and key, then the queries. No row carries a query's vector before."""
    whole = index.vectors().select("cell", "key", "embedding").hint("merge")
    return found.join(whole, ["cell", "key"]).join(queries.select("source_id", "q"), "source_id").select("source_id", "paper_id", dot(F.col("embedding"), F.col("q")).alias("score"))


def _top(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "paper_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search(
    index: Index, queries: DataFrame, n: int = 10, probes: int = 8, exact: bool = True, least: float | None = None, section: str | None = None, exclude: list[int] | None = None
) -> DataFrame:
    """source_id, paper_id, score, rank: the n nearest vectors of other papers of the same workspace for each query.

    queries: source_id, workspace_id, q; source ids must differ. With exact, every cell that may hold one of the n best rows is looked at, and
    the result is that of a scan of all vectors; else the `probes` cells nearest to a query are. The floor of both is the n-th of some exact scores
    in the nearest cells. section and exclude (paper ids) stand below the top n; least is applied after it. Ties go to the smaller paper_id.
    """
    spark, out = index.spark, tuple(exclude or ())
    q = kept(queries.select("source_id", "workspace_id", F.col("q").cast("array<float>").alias("q"), F.lit(float("-inf")).alias("floor")), new_path(spark, "queries"))
    tried = _tried(index, q, min(probes, START), TRIED * n, section, out)
    nth = _top(_exact(index, tried, q), n).where(F.col("rank") == n).select("source_id", (F.col("score") - SLACK).alias("nth"))
    q = kept(q.join(nth, "source_id", "left").select("source_id", "workspace_id", "q", F.coalesce("nth", "floor").alias("floor")), new_path(spark, "floors"))
    near = _top(_exact(index, _candidates(index, q, None if exact else probes, n, section, out), q), n)
    return near if least is None else near.where(F.col("score") >= least)


def nearest(index: Index, query: list[float], workspace: str, n: int = 15, probes: int = 8, section: str | None = None, exclude: list[int] | None = None) -> DataFrame:
    """paper_id, score, rank of one query in its `probes` nearest cells, whose folders alone are read."""
    q = np.array(query, dtype=np.float64)
    score = np.where(index.radius >= 0, index.centres @ q, -np.inf)
    cells = [int(c) for c in np.argsort(-score, kind="stable")[:probes]]
    spark = index.spark
    packs = spark.createDataFrame([(workspace, c, [-1], [float("-inf")], [float(x) for x in query]) for c in cells], QUERIES)
    here = index.blocks().where(F.col("cell").isin(*cells))
    found = here.join(F.broadcast(packs), ["workspace_id", "cell"]).mapInArrow(_scan(index, n, section, tuple(exclude or ())), HITS)
    whole = index.vectors().where(F.col("cell").isin(*cells)).select("cell", "key", "embedding")
    scores = found.join(whole, ["cell", "key"]).select("source_id", "paper_id", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")).alias("score"))
    return _top(scores, n).drop("source_id")
