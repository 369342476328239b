"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import stored

#: Base kinds in their order, with the group whose length counts and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24))
#: What the battery looks at: runs of the characters of the encodings below.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order in which they are tried: name, pattern of the body, alphabet.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: What ordinary text in an encoding's characters looks like: the sum of its characters' squared and cubed shares, and the share
#: of neighbours that are of unlike kind (lower case, upper case, digit, other). Words, identifiers and paths stay below that
#: evenness; text in hex characters is decimal numbers.
TEXT = {"hex": (0.10, 0.0104, 0.15), "base32": (0.066, 0.0055, 0.08), "alnum": (0.055, 0.004, 0.30), "base64": (0.055, 0.004, 0.30), "base64url": (0.055, 0.004, 0.30)}
#: A token that is no random one has a serial correlation this far from 0 or more.
SERIAL = 0.7
#: Tested tokens.
TESTS = "array<struct<start:int,end:int,encoding:string,n:int,p:double>>"
#: Bins of a p-value's logarithm, per stratum.
P_BINS = 60


def _once(x: Column, use) -> Column:
    """use(x), an array, with x computed once: what a lambda reads from outside is computed again for each element."""
    return F.flatten(F.transform(F.array(x), use))


def _before(lengths: Column) -> Column:
    """Sums of all earlier elements; in blocks of 64, so that thousands of matches in a text stay cheap."""
    zero, add = F.lit(0), lambda a, x: a + x
    at = lambda i: F.floor(i / 64).cast("int")

    def sums(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), at(F.size(own) - 1)), lambda j: F.aggregate(F.slice(own, j * 64 + 1, 64), zero, add))
        inside = lambda i, b: F.aggregate(F.slice(b, F.lit(1), at(i)), zero, add) + F.aggregate(F.slice(own, at(i) * 64 + 1, i % 64), zero, add)
        return _once(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: inside(i, b)))

    return F.when(F.size(lengths) > 0, _once(lengths, sums)).otherwise(F.array().cast("array<int>"))


def found(df: DataFrame, text: str, pattern: str, out: str, has: Column | None = None) -> DataFrame:
    """Adds out: array of (start, end, whole) of the pattern's leftmost non-overlapping matches, in code points.

    has, if given, is true for each text with a match, and cheaper than the pattern."""
    gaps, hits, lens = f"qm_g_{out}", f"qm_h_{out}", f"qm_l_{out}"
    has = F.col(text).rlike(pattern) if has is None else has
    df = df.withColumn(hits, F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.transform(F.split(text, pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>")))
    # A match begins after all gaps up to its own and all earlier matches.
    df = df.withColumn(lens, F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(hits)), hits, lambda g, h: g + F.char_length(h)))
    starts = F.zip_with(_before(F.col(lens)), F.slice(F.col(gaps), F.lit(1), F.size(hits)), lambda b, g: b + g)
    return df.withColumn(
        out,
        F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("whole"))),
    ).drop(gaps, hits, lens)


def _long_enough(matches: str, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    def long(x: Column) -> Column:
        return F.char_length(F.regexp_extract(x["whole"], pattern, group) if group else x["whole"]) >= least

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(F.filter(matches, long), span)


def _may_have(text: str) -> dict[str, Column]:
    """Per kind a condition that each text with a match meets. Matches of access and hex are runs that CANDIDATE finds as well."""
    low = F.lower(F.col(text))
    assigns = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.exists(F.array(*map(F.lit, ("passw", "secret", "token", "api"))), lambda k: F.contains(low, k))
    return {"assign": assigns, "access": F.col("qm_long"), "hex": F.col("qm_long")}


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the spans of the fixed patterns by start, then kind as listed. Matches that are too short are dropped.

    Adds qm_long too: whether the text has any run of the encodings' characters that is long enough to be tested."""
    df = df.withColumn("qm_long", F.col(text).rlike(CANDIDATE))
    may = _may_have(text)
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        df = found(df, text, pattern, f"qm_{kind}", may[kind])
        df = df.withColumn(f"qm_{kind}", _long_enough(f"qm_{kind}", rank, kind, pattern, group, least))
    return df.withColumn(out, F.array_sort(F.concat(*[F.col(f"qm_{k}") for k, *_ in KINDS]))).drop(*[f"qm_{k}" for k, *_ in KINDS])


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a logistic form that is within 0.0002."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _sum(values: Column, zero=0.0, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, x: a + of(x))


def _paired(values: Column, of) -> Column:
    """of(later, earlier) for all neighbours."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(2), n - 1), F.slice(values, F.lit(1), n - 1), of)


def battery(found: Column) -> Column:
    """Adds encoding, n and p to each struct (start, end, whole) of an array; drops those of no known encoding.

    p is the p-value of the hypothesis that the token is no random text in its inferred encoding. Three tests on its
    characters, each against what ordinary text looks like (TEXT): chi-squared, whether they are used more evenly; runs,
    whether there are more runs of one kind of character; serial correlation of neighbours' places in the alphabet, whether
    it is nearer to 0 than a sequence's. A token must pass all three, so p is the largest of theirs: an intersection-union
    test, which needs no independence. Each step is a transform of its own, so that nothing is computed twice.
    """
    table = lambda values: F.create_map(*[F.lit(x) for name, v in values.items() for x in (name, v)])
    alphabets = table({name: alphabet for name, _, alphabet in ENCODINGS})
    whole = ENCODINGS[-1][2] + "+/"
    kinds = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-" for c in whole)

    def encoded(x: Column) -> Column:
        body = F.rtrim(x["whole"], F.lit("="))
        kind = F.lit(None).cast("string")
        for name, pattern, _ in reversed(ENCODINGS):
            kind = F.when(body.rlike(pattern), name).otherwise(kind)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), body.alias("body"), kind.alias("encoding"))

    def read(x: Column) -> Column:
        body = F.when(x["encoding"] == "hex", F.lower(x["body"])).otherwise(x["body"])
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), F.char_length(body).alias("n"), body.alias("body"), F.split(body, "").alias("c"),
            F.element_at(alphabets, x["encoding"]).alias("letters"),
        )

    def counted(x: Column) -> Column:
        same = ("start", "end", "encoding", "n")
        uses = F.transform(F.array_distinct(x["c"]), lambda c: x["n"] - F.char_length(F.replace(x["body"], c, F.lit(""))))
        places = F.transform(x["c"], lambda c: F.call_function("instr", x["letters"], c).cast("double"))
        runs = F.char_length(F.regexp_replace(F.translate(x["body"], whole, kinds), "A+|a+|0+|-+", "x"))
        return F.struct(
            *[x[k].alias(k) for k in same],
            F.char_length(x["letters"]).cast("double").alias("k"),
            _sum(uses, 0.0, lambda u: u.cast("double") * u).alias("squares"),
            (runs - 1).cast("double").alias("turns"),
            places.alias("v"),
            (_sum(places, 0.0) / x["n"]).alias("mean"),
        )

    def tested(x: Column) -> Column:
        n, k = x["n"].cast("double"), x["k"]
        of = lambda i: F.element_at(table({name: v[i] for name, v in TEXT.items()}), x["encoding"])
        two, three, turn = of(0), of(1), of(2)
        chi = lambda squares: k / n * squares - n
        spread = k / n * F.sqrt(2 * n * (n - 1) * (two - two * two) + 4 * n * (n - 1) * (n - 2) * F.greatest(three - two * two, F.lit(0.0)))
        about = _sum(x["v"], 0.0, lambda v: (v - x["mean"]) * (v - x["mean"]))
        lagged = _sum(_paired(x["v"], lambda a, b: (a - x["mean"]) * (b - x["mean"])), 0.0)
        z_chi = (chi(n + n * (n - 1) * two) - chi(x["squares"])) / spread
        z_runs = (x["turns"] - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
        # A token of one character alone is wholly correlated.
        z_serial = (SERIAL - F.when(about > 0, F.abs(lagged / F.greatest(about, F.lit(1e-9)))).otherwise(1.0)) * F.sqrt(n)
        p = F.greatest(*[_upper_tail(z) for z in (z_chi, z_runs, z_serial)])
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), x["n"].alias("n"), F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p")
        )

    known = F.filter(F.transform(found, encoded), lambda x: x["encoding"].isNotNull())
    return F.transform(F.transform(F.transform(known, read), counted), tested)


def _parts(x: Column, masked: Column, cuts: str) -> Column:
    """The parts (start, end, whole) of a token x between the characters that cuts matches in masked, 20 characters long or more."""
    pieces = F.split(masked, cuts, -1)
    at = _before(F.transform(pieces, lambda p: F.char_length(p) + 1))
    made = F.zip_with(at, pieces, lambda i, p: F.struct((x["start"] + i).alias("start"), (x["start"] + i + F.char_length(p)).alias("end"), p.alias("whole")))
    return F.filter(made, lambda p: F.char_length(F.rtrim(p["whole"], F.lit("="))) >= 20)


def with_candidates(df: DataFrame, text: str, base: str, out: str) -> DataFrame:
    """Adds out: tokens to be tested (start, end, encoding, n, p): what base spans leave uncovered of each run of the encodings' characters.

    No encoding has both '/' or '+' and '_' or '-'; a run with both is tested by its parts between the ones, and between
    the others. Parts under 20 characters are not tested. df has qm_long, as with_base_spans leaves it; it is dropped.
    """
    df = found(df, text, CANDIDATE, "qm_cand", F.col("qm_long"))
    touch = lambda b, x: (b["start"] < x["end"]) & (x["start"] < b["end"])

    def hidden(x: Column) -> Column:
        def hide(whole: Column, b: Column) -> Column:
            lo, hi = F.greatest(b["start"] - x["start"], F.lit(0)), F.least(b["end"], x["end"]) - x["start"]
            return F.concat(F.substring(whole, F.lit(1), lo), F.repeat(F.lit(" "), hi - lo), F.substring(whole, hi + 1, F.char_length(whole)))

        return F.aggregate(F.filter(base, lambda b: touch(b, x)), x["whole"], hide)

    free = F.flatten(F.transform("qm_cand", lambda x: F.when(F.exists(base, lambda b: touch(b, x)), _parts(x, hidden(x), " ")).otherwise(F.array(x))))
    df = df.withColumn("qm_free", F.when(F.size("qm_cand") > 0, free).otherwise(F.col("qm_cand")))
    mixed = lambda x: x["whole"].rlike("[+/]") & x["whole"].rlike("[_-]")
    both = lambda x: F.concat(_parts(x, x["whole"], "[+/]"), _parts(x, x["whole"], "[_-]"))
    known = F.array_distinct(F.flatten(F.transform("qm_free", lambda x: F.when(mixed(x), both(x)).otherwise(F.array(x)))))
    df = df.withColumn("qm_cand", F.when(F.size("qm_free") > 0, known).otherwise(F.col("qm_free")))
    return df.withColumn(out, F.when(F.size("qm_cand") > 0, battery(F.col("qm_cand"))).otherwise(F.array().cast(TESTS))).drop("qm_cand", "qm_free", "qm_long")


def _stratum(test: Column) -> Column:
    return F.concat_ws(":", test["encoding"], F.floor(F.log2(test["n"])).cast("string"))


def _bin(p: Column) -> Column:
    return F.least(F.lit(P_BINS - 1), F.floor(-F.log10(p) * P_BINS / 9).cast("int"))


def random_limits(tested: DataFrame, column: str, rate: float = 0.05) -> dict[str, int]:
    """Per stratum (encoding and power of two of the length) the least bin whose tokens are reported; none where no token is.

    Benjamini and Hochberg's procedure within each stratum: of the tokens it reports, the share that is ordinary text is
    expected to be rate at most. Longer tokens, on which the tests see more, are judged among themselves. p-values count by
    bins of their logarithm, each at its largest value, so the driver gets at most P_BINS numbers a stratum.
    """
    tests = tested.select(F.explode_outer(column).alias("t")).where("t is not null")
    counts = tests.groupBy(_stratum(F.col("t")).alias("s"), _bin(F.col("t.p")).alias("b")).count().collect()
    limits: dict[str, int] = {}
    for s in {r["s"] for r in counts}:
        bins = {r["b"]: r["count"] for r in counts if r["s"] == s}
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-9 * b / P_BINS) <= rate * above / total:
                limits[s] = b
    return limits


def with_random(tested: DataFrame, limits: dict[str, int], base: str, tests: str, out: str) -> DataFrame:
    """Adds out: base's spans, and those of the tokens in tests that the limits report, as "random"."""
    if not limits:
        return tested.withColumn(out, F.col(base))
    table = F.create_map(*[F.lit(x) for s, b in sorted(limits.items()) for x in (s, b)])
    limit = lambda t: F.coalesce(F.try_element_at(table, _stratum(t)), F.lit(P_BINS))
    kept = F.transform(
        F.filter(tests, lambda x: _bin(x["p"]) >= limit(x)),
        lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit("random").alias("kind")),
    )
    return tested.withColumn(out, F.when(F.size(tests) > 0, F.array_sort(F.concat(F.col(base), kept))).otherwise(F.col(base)))


def span_string(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null texts are empty; a text without a find has counts 0 and empty span lists. Repeated rows get equal results. An
    empty table gives no row; other columns are ignored. Texts are read once; spans and tests are stored, as the limits come
    from the tests of the whole table: whether a token is reported depends on what else the table holds.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("qm_text"))
    rows = with_candidates(with_base_spans(rows, "qm_text", "qm_base"), "qm_text", "qm_base", "qm_tests")
    tested = stored(rows.select("doc_id", "qm_base", "qm_tests"), "secret-tests")
    rows = with_random(tested, random_limits(tested, "qm_tests", rate), "qm_base", "qm_tests", "qm_spans")
    count = lambda k: F.size(F.filter("qm_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *[count(k) for k, *_ in KINDS],
        F.sha2(span_string("qm_base"), 256).alias("base_sha256"),
        span_string("qm_spans").alias("spans"),
    )


def _reached(spans: str) -> Column:
    """For each span the furthest end before it, and at last that of all; in blocks of 64, like _before."""
    n, far, zero = F.size(spans), lambda a, x: F.greatest(a, x["end"]), F.lit(0)
    at = lambda i: F.floor(i / 64).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), at(n)), lambda j: F.aggregate(F.slice(F.col(spans), j * 64 + 1, 64), zero, far))
    before = lambda b, i: F.greatest(zero, F.coalesce(F.array_max(F.slice(b, F.lit(1), at(i))), zero))
    return _once(blocks, lambda b: F.transform(F.sequence(zero, n), lambda i: F.aggregate(F.slice(F.col(spans), at(i) * 64 + 1, i % 64), before(b, i), far)))


#: Characters of a block that pieces of texts with many spans are taken from.
TEXT_BLOCK = 1024


def _blocks(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / TEXT_BLOCK).cast("int")), lambda i: F.substring(text, i * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)))


def _piece(blocks: Column, begin: Column, length: Column) -> Column:
    """length characters from begin on, of a text in blocks."""
    at = lambda x: F.floor(x / TEXT_BLOCK).cast("int")
    first, last = F.element_at(blocks, at(begin) + 1), F.element_at(blocks, at(begin + length) + 1)
    between = F.array_join(F.slice(blocks, at(begin) + 2, F.greatest(at(begin + length) - at(begin) - 1, F.lit(0))), "")
    apart = F.concat(F.substring(first, begin % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), between, F.substring(last, F.lit(1), (begin + length) % TEXT_BLOCK))
    return F.when(at(begin) == at(begin + length), F.substring(first, begin % TEXT_BLOCK + 1, length)).otherwise(apart)


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """docs, same columns, with each stretch of text that spans cover replaced by the mark; n_chars follows the text.

    Null and empty texts stay as they are, and so does each text without a find. Repeated rows get equal results. An empty
    table gives an empty one; other columns, whatever their names, are passed on.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("qm_row"), F.coalesce(F.col("text"), F.lit("")).alias("qm_text"))
    rows = with_candidates(with_base_spans(rows, "qm_text", "qm_base"), "qm_text", "qm_base", "qm_tests")
    tested = stored(rows.select("qm_row", "qm_base", "qm_tests"), "secret-rows")
    rows = with_random(tested, random_limits(tested, "qm_tests", rate), "qm_base", "qm_tests", "qm_spans")
    rows = rows.withColumn("qm_reach", F.when(F.size("qm_spans") > 0, _reached("qm_spans")))
    text = F.col("qm_row.text")
    # Pieces of texts with many spans are taken from blocks, so that none is counted off from the text's begin.
    rows = rows.withColumn("qm_c", F.when(F.size("qm_spans") > 32, _blocks(text)))
    part = lambda begin, length: F.when(F.col("qm_c").isNull(), F.substring(text, begin + 1, length)).otherwise(_piece(F.col("qm_c"), begin, length))
    # A span adds what it has beyond the furthest end before it; one that begins inside an earlier one adds no mark.
    piece = lambda x, e: F.when(x["start"] >= e, F.concat(part(e, x["start"] - e), F.lit(mark))).otherwise("")
    rows = rows.withColumn("qm_last", F.element_at("qm_reach", -1))
    joined = F.concat(
        F.array_join(F.zip_with("qm_spans", F.slice(F.col("qm_reach"), F.lit(1), F.size("qm_spans")), piece), ""),
        part(F.col("qm_last"), F.greatest(F.char_length(text) - F.col("qm_last"), F.lit(0))),
    )
    rows = rows.withColumn("qm_new", F.when(F.size("qm_spans") > 0, joined))

    def column(c: str) -> Column:
        old = F.col("qm_row")[c]
        if c == "text":
            return F.coalesce("qm_new", old).alias(c)
        if c == "n_chars":
            return F.when(F.col("qm_new").isNotNull(), F.char_length("qm_new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return rows.select(*[column(c) for c in docs.columns])
