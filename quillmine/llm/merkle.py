"""Merkle fingerprints of documents over paragraphs and sections, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import partitions, range_bounds, range_bucket

#: A leaf: up to four words with the white space around them.
LEAF = r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,4}|[\x20\x09-\x0D]+"

#: Hexadecimal digits of a leaf's digest in a fingerprint, and of a paragraph's and section's. With 48 bits two unrelated texts
#: of a million words have a common leaf by chance once in five thousand times.
LEAF_DIGITS, NODE_DIGITS = 12, 16


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the column out: root|sections|paragraphs|leaves.

    Sections are parted by an empty line, paragraphs by a line end, leaves hold four words. A leaf's digest is MD5 of its
    text, a paragraph's, section's and the root's SHA-256 of its children's digests. The string has the whole root,
    NODE_DIGITS digits and the number of children of each section and paragraph, LEAF_DIGITS digits of each leaf. Null counts
    as empty.
    """
    tree = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n\n", -1),
        lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5)),
    )
    digest = lambda children: F.sha2(F.array_join(children, ""), 256)
    t, p, s = f"qm_t_{out}", f"qm_p_{out}", f"qm_s_{out}"
    df = df.withColumn(t, tree)
    df = df.withColumn(p, F.transform(t, lambda s: F.transform(s, digest)))
    df = df.withColumn(s, F.transform(p, digest))
    short = lambda d, n: F.concat(F.substring(d, 1, NODE_DIGITS), F.lit(":"), n.cast("string"))
    return df.withColumn(
        out,
        F.concat_ws(
            "|",
            digest(F.col(s)),
            F.array_join(F.zip_with(s, p, lambda d, c: short(d, F.size(c))), " "),
            F.array_join(F.zip_with(F.flatten(p), F.flatten(t), lambda d, c: short(d, F.size(c))), " "),
            F.array_join(F.transform(F.flatten(F.flatten(t)), lambda d: F.substring(d, 1, LEAF_DIGITS)), " "),
        ),
    ).drop(t, p, s)


def _part(fingerprint: Column, i: int) -> Column:
    return F.filter(F.split(F.split_part(fingerprint, F.lit("|"), F.lit(i)), " "), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the common leaves by all leaves of both, each distinct leaf once; 1 only if the roots are equal."""
    la, lb = F.array_distinct(_part(a, 4)), F.array_distinct(_part(b, 4))
    total = (F.size(la) + F.size(lb)).cast("double")
    dice = F.lit(2.0) * F.size(F.array_intersect(la, lb)) / F.nullif(total, F.lit(0.0))
    same = F.split_part(a, F.lit("|"), F.lit(1)) == F.split_part(b, F.lit("|"), F.lit(1))
    return F.when(same, 1.0).otherwise(F.least(F.coalesce(dice, F.lit(0.0)), 1 - 1 / (1 + total)))


def differing(a: Column, b: Column, level: str = "paragraphs") -> Column:
    """Positions, from 0, of a's sections, paragraphs or leaves whose digest stands nowhere in b: where a was edited."""
    i = {"sections": 2, "paragraphs": 3, "leaves": 4}[level]
    pa, pb = _part(a, i), _part(b, i)
    return F.filter(
        F.transform(pa, lambda x, k: F.when(~F.array_contains(pb, x), k).otherwise(-1)), lambda k: k >= 0
    )


def edited_paragraphs(a: str, b: str) -> Column:
    """Positions, from 0 and joined by commas, of the paragraphs of a that b doesn't have, found from the root down: nowhere if the
    roots are equal, else only below sections whose digest stands nowhere in b. a and b name columns of fingerprints."""
    part = lambda c, i: _part(F.col(c), i)
    sections, paragraphs = part(a, 2), part(a, 3)
    new = lambda i: F.array_except(part(a, i), part(b, i))
    # Each section's numbers of its first and last paragraph come from the numbers of children before it.
    below = F.flatten(F.transform(sections, lambda s: F.array_repeat(s, F.split_part(s, F.lit(":"), F.lit(2)).cast("int"))))
    both = lambda sec, par: F.zip_with(
        below, paragraphs, lambda s, p: F.array_contains(sec, s) & F.array_contains(par, p)
    )
    flags = F.get(F.transform(F.array(F.struct(new(2).alias("s"), new(3).alias("p"))), lambda x: both(x["s"], x["p"])), F.lit(0))
    at = F.filter(F.transform(flags, lambda f, k: F.when(f, k).otherwise(-1)), lambda k: k >= 0)
    same = F.split_part(F.col(a), F.lit("|"), F.lit(1)) == F.split_part(F.col(b), F.lit("|"), F.lit(1))
    return F.when(same, "").otherwise(F.array_join(F.transform(at, lambda k: k.cast("string")), ","))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), qm_b and own: every row once with own 1, in the range qm_b of its doc_id.

    The last row of each range stands in the range above as well (of the highest in the lowest), with own 0. So sorted by
    (own, doc_id, text) within its range, each row's predecessor is the next one by descending doc_id, after the last the
    first, and one shuffle of the texts is enough. Ranges are cut at quantiles. Null ids are lowest.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("qm_b", range_bucket(F.col("doc_id"), range_bounds(rows, "doc_id", 4 * partitions(docs.sparkSession))))
    # A row per range goes to the driver: at most 4 times the shuffle partitions.
    tops = {r["qm_b"]: r["top"] for r in rows.groupBy("qm_b").agg(F.max("doc_id").alias("top")).collect()}
    if not (order := sorted(tops)):
        return rows.withColumn("own", F.lit(1))
    at = lambda values: F.element_at(F.create_map(*[x for b, v in values.items() for x in (F.lit(b), v)]), F.col("qm_b"))
    top = at({b: F.lit(v).cast("long") for b, v in tops.items()})
    above = at({b: F.lit(order[(i + 1) % len(order)]) for i, b in enumerate(order)})
    place = lambda b, own: F.struct(b.alias("qm_b"), F.lit(own).alias("own"))
    places = F.when(F.col("doc_id").eqNullSafe(top), F.array(place(F.col("qm_b"), 1), place(above, 0)))
    places = places.otherwise(F.array(place(F.col("qm_b"), 1)))
    return rows.select("doc_id", "text", F.explode(places).alias("qm_at")).select("doc_id", "text", "qm_at.*")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all) of the next text by
    descending doc_id. Null texts are empty; an empty text is edited to itself, and two empty texts have likeness 1. A
    lone row is its own next. edited_paragraphs has the positions of the edited text's paragraphs that the text doesn't have, found
    by descending from unequal nodes. Rows that share a doc_id, or have none, are ordered by text. An empty table gives no row; other columns are ignored.
    """
    near = Window.partitionBy("qm_b").orderBy("own", F.col("doc_id").asc_nulls_first(), "text")
    rows = beside_next(docs).withColumn("qm_next", F.lag("text").over(near))
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = (
        rows.withColumn("qm_next_fp", F.lag("fingerprint").over(near))
        .where("own = 1")
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("qm_k", F.floor(F.col("n_chars") / 3).cast("int"))
        .withColumn(
            "qm_edited",
            F.concat(
                F.expr("substring(text, 1, cast(n_chars as int) - qm_k)"),
                F.expr("substring(qm_next, 1, qm_k)"),
            ),
        )
    )
    rows = with_fingerprint(rows, "qm_edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("qm_edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("qm_next_fp")).alias("near_next"),
        edited_paragraphs("edited_fingerprint", "fingerprint").alias("edited_paragraphs"),
    )


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
n AS (SELECT *, coalesce(lag(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC)) AS nx,
      row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS i FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(nx, 1, n_chars // 3) AS edited FROM n),
x AS (SELECT i, 0 AS k, text AS t FROM e UNION ALL SELECT i, 1, edited FROM e),
t AS (SELECT i, k, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
      list_transform(regexp_extract_all(p, '@leaf'), lambda l: md5(l)))) AS t FROM x),
p AS (SELECT *, list_transform(t, lambda s: list_transform(s, lambda p: sha256(coalesce(array_to_string(p, ''), '')))) AS p FROM t),
s AS (SELECT *, list_transform(p, lambda x: sha256(array_to_string(x, ''))) AS s FROM p),
f AS (SELECT i, k, sha256(array_to_string(s, '')) AS root, list_distinct(list_transform(flatten(flatten(t)), lambda l: l[1:@leafdigits])) AS leaves,
      sha256(array_to_string(s, '')) || '|' || array_to_string(list_transform(list_zip(s, p), lambda z: z[1][1:@nodedigits] || ':' || len(z[2])), ' ') || '|'
      || array_to_string(list_transform(list_zip(flatten(p), flatten(t)), lambda z: z[1][1:@nodedigits] || ':' || len(z[2])), ' ') || '|'
      || coalesce(array_to_string(list_transform(flatten(flatten(t)), lambda l: l[1:@leafdigits]), ' '), '') AS fp,
      list_transform(list_zip(s, p), lambda z: z[1][1:@nodedigits] || ':' || len(z[2])) AS ss,
      flatten(list_transform(list_zip(s, p), lambda z: list_transform(z[2], lambda x: z[1][1:@nodedigits] || ':' || len(z[2])))) AS below,
      list_transform(list_zip(flatten(p), flatten(t)), lambda z: z[1][1:@nodedigits] || ':' || len(z[2])) AS ps FROM s),
j AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, a.root AS ra, b.root AS rb, c.root AS rc,
      array_to_string(list_filter(list_transform(list_zip(b.below, b.ps), lambda z, k: CASE WHEN NOT list_contains(a.ss, z[1]) AND NOT list_contains(a.ps, z[2]) THEN k - 1 END), lambda k: k IS NOT NULL), ',') AS places,
      len(list_intersect(a.leaves, b.leaves)) AS ib, len(list_intersect(a.leaves, c.leaves)) AS ic, CAST(len(a.leaves) + len(b.leaves) AS DOUBLE) AS tb, CAST(len(a.leaves) + len(c.leaves) AS DOUBLE) AS tc
      FROM e JOIN f a ON a.i = e.i AND a.k = 0 JOIN f b ON b.i = e.i AND b.k = 1
      JOIN f c ON c.k = 0 AND c.i = CASE WHEN e.i = 1 THEN (SELECT max(i) FROM e) ELSE e.i - 1 END)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN ra = rb THEN 1e0 ELSE least(coalesce(2e0 * ib / nullif(tb, 0e0), 0e0), 1 - 1 / (1 + tb)) END AS near_edited,
       CASE WHEN ra = rc THEN 1e0 ELSE least(coalesce(2e0 * ic / nullif(tc, 0e0), 0e0), 1 - 1 / (1 + tc)) END AS near_next,
       CASE WHEN ra = rb THEN '' ELSE coalesce(places, '') END AS edited_paragraphs
FROM j
""".replace("@leafdigits", str(LEAF_DIGITS)).replace("@nodedigits", str(NODE_DIGITS)).replace("@leaf", LEAF)
