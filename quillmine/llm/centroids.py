"""Centroid clustering of integer vectors by Elkan's bounds: exact assignments, most distances never computed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import stored

#: Bounds are widened by this share, some eight times what rounding can take from them.
SLACK = 2.0**-50
#: Vectors with their bounds: what a round leaves to the next one.
STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<double>, distance long, calculated int"


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor a non-finite entry."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and x, the components floor(scale * c), of the vectors with dims components, none of them null or non-finite.

    Components must leave squared distances in 63 bits (some 80 million at 64 dimensions); a larger one fails with a message.
    """
    most = int((2.0**61 / dims) ** 0.5 / 2)
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == dims) & finite(F.col("embedding")))
    large = F.exists("x", lambda v: F.abs(v) > most)
    checked = F.when(large, F.raise_error(F.lit(f"a component is beyond {most}: squared distances would not fit"))).otherwise(F.col("x").cast("array<int>"))
    return kept.select("vec_id", x.alias("x")).select("vec_id", checked.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (or all, if fewer) of the least sha256 of `seed:vec_id`, in that order; ties by components, null ids last."""
    named = vectors.withColumn("qm_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy(F.col("qm_hash").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def assigned(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Moves each vector to its nearest centroid, the smallest number on ties; (exact squared distances or -1, number of those computed).

    cluster, upper and lower are changed in place: upper is above the distance to the vector's own centroid, lower below that to
    each one. A centroid is left out only where bounds show it to be strictly farther than the own one: half its distance
    from the own centroid, or its lower bound, exceeds upper. Whatever may tie is computed as an integer. exact asks
    for the distance to the own centroid of every vector, pruned or not.
    """
    n, k = lower.shape
    near = _below(_squared(centres[:, None], centres[None])) / 2
    np.fill_diagonal(near, np.inf)
    own, known, calculated = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int32)

    def tighten(at: np.ndarray) -> None:
        own[at] = _squared(x[at], centres[cluster[at]])
        upper[at], lower[at, cluster[at]], known[at] = _above(own[at]), _below(own[at]), True
        calculated[at] += 1

    may = np.flatnonzero(upper >= near.min(axis=1)[cluster])
    for c in range(k):
        left = lambda at, c=c: at[(cluster[at] != c) & (upper[at] >= lower[at, c]) & (upper[at] >= near[cluster[at], c])]
        at = left(may)
        tighten(at[~known[at]])
        at = left(at)
        d = _squared(x[at], centres[c])
        lower[at, c] = _below(d)
        calculated[at] += 1
        wins = (d < own[at]) | ((d == own[at]) & (c < cluster[at]))
        won = at[wins]
        cluster[won], own[won], upper[won] = c, d[wins], _above(d[wins])
    if exact:
        tighten(np.flatnonzero(~known))
    return own, calculated


def _round(centres: np.ndarray, moved: np.ndarray | None, exact: bool):
    """A map of Arrow batches: vectors alone (moved is None) or with the state of the round before, to the state of this one."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            if moved is None:
                cluster, upper, lower, before = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k)), np.zeros(n, np.int32)
            else:
                cluster, before = b.column("cluster").to_numpy().copy(), b.column("calculated").to_numpy()
                upper = (b.column("upper").to_numpy() + moved[cluster]) * (1 + SLACK)
                lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
                lower = np.maximum((lower - moved) * (1 - SLACK), 0)
            own, calculated = assigned(x, centres, cluster, upper, lower, exact)
            bounds = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), lower.ravel())
            columns = [b.column("vec_id"), b.column("x"), pa.array(cluster), pa.array(upper), bounds, pa.array(own), pa.array(before + calculated)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cluster", "upper", "lower", "distance", "calculated"])

    return run


def new_centroids(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, component by component, in integers; an empty cluster's centroid stays.

    Sums are formed in every task first: a row per cluster leaves it, however hot a cluster is. A row per cluster goes to the driver.
    """
    dims = centres.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i)).cast("long")) for i in range(dims)]).alias("s"))
    out = centres.copy()
    for r in sums.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def elkan(vectors: DataFrame, centres: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids): vectors (vec_id, x) assigned, moved by `rounds` updates of the centroids and assigned once more.

    Every round is a written table, so lineage stays short and a lost executor costs a task. Bounds travel with the vectors;
    only centroids, k rows, go through the driver. state holds exact squared distances and the number of distances computed.
    """
    step = lambda df, c, moved, last: stored(df.mapInArrow(_round(c, moved, last), STATE), "clusters")
    state = step(vectors, centres, None, rounds == 0)
    for i in range(rounds):
        moved_to = new_centroids(state, centres)
        moved = _above(_squared(centres, moved_to))
        centres = moved_to
        state = step(state, centres, moved, i == rounds - 1)
    return state, centres


def centroid_clusters(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors (vec_id, embedding) that are null, have not dims components, or hold null or non-finite entries are left out; the
    others become integers floor(scale * c). With fewer than k vectors there are as many centroids. A vector as
    near to two centroids goes to the smaller number. Repeated rows are vectors of their own and fare alike; of equal vec_ids the
    lesser vector is the earlier centroid; a null vec_id comes last there and is returned as null. Other columns are
    ignored. An empty table gives no row. Inertias are sums of squared distances and must fit 63 bits, else the sum fails.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, dims, scale)
    centres = first_centroids(ints, k, seed)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], result)
    state, centres = elkan(ints, centres, rounds)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = lambda c: hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()
    rows = [(c, s, sum(sums.values()), named(c)) for c, s in sums.items()]
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows at most
    return state.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """The same in DuckDB's SQL, with every distance computed."""
    near = "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} m) GROUP BY rid"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS ({near.format(i=i)})")
        # Floor division: the remainder is taken to be positive first.
        parts.append(
            f"""s{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM
      (SELECT c, i, sum(e) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{i} a JOIN v USING (rid)) GROUP BY c, i) GROUP BY c)"""
        )
        parts.append(f"c{i + 1} AS (SELECT c, coalesce(s.x, m.x) AS x FROM c{i} m LEFT JOIN s{i} s USING (c))")
    parts.append(f"a{rounds} AS ({near.format(i=rounds)})")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} m USING (c)"""
    )
