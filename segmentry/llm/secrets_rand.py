"""Secret scans by a battery of randomness tests, in DataFrame operations only.

Base findings are those of three patterns (see KINDS). The battery adds strings that look like key
material: runs of LEAST_RUN or more characters of the usual encodings. The encoding of a run is
inferred from its characters; every run with a letter has one, and a run of digits alone (dates, numbers) is not key
material. Under the hypothesis of independent uniform symbols three statistics are near-normal: chi-squared over
the alphabet, runs above and below the alphabet's middle, and serial correlation at lag 1. The
least of their two-sided probabilities, times three, is the run's. Runs whose alphabet and length allow fewer than
LEAST_BITS bits, or that are too short for the battery to tell their alphabet from ordinary words, are not tested.

Rejections are controlled by the Benjamini-Hochberg rule within strata of encoding and length
class (powers of two), because short strings give weak tests: runs for which randomness is
rejected are structured and are left out; the others are added. So the rate that is bounded is that of random strings
among those left out (missed keys); the rate of structured strings among those added has no bound.
Probabilities are counted over all documents on a grid of tenths of a decade, so what the driver sees
is at most encodings x length classes x GRID numbers.

Positions are code points, end exclusive, found from the pieces between matches. Sums over matches are taken in blocks, so
a text with very many matches costs little more than its length.

Results for odd rows: a null text counts as empty; an empty text has no span, and base_sha256 is that of the
empty string; every input row gives one row, repeated rows equal ones; overlapping spans of different
kinds are all reported, but an added span inside a base one is not.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds and patterns of the base findings, in their order: fixed values.
KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
LEAST_VALUE = 12
LEAST_RUN = 20
RUNS = r"[A-Za-z0-9+/_-]{%d,}=*" % LEAST_RUN
#: Alphabets in the order of inference, each with the pattern of its runs: fixed values. In all but the last, - and _ part a
#: run and are no symbols. The last number is the least length: with letters in the shares of ordinary text (sum of
#: squares 0.065), chi-squared of 26 symbols rejects most runs from 41 letters on, of 52 symbols from 22 on.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f_-]+=*$", 2),
    ("HEX", "0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F_-]+=*$", 2),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7_-]+=*$", 2),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z_-]+=*$", 2),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z_-]+=*$", 2),
    ("base26", "abcdefghijklmnopqrstuvwxyz", r"^(?=.*[a-z])[a-z_-]+=*$", 41),
    ("BASE26", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^(?=.*[A-Z])[A-Z_-]+=*$", 41),
    ("base52", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z_-]+=*$", 22),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[A-Za-z])[A-Za-z0-9+/_-]+=*$", 2),
)
LEAST_BITS = 80
#: Rate of false rejections among the rejected runs.
RATE = 0.05
#: Tenths of a decade that probabilities are counted on; smaller ones are in the last.
GRID = 300
#: Numbers that are summed in one array, and code points of a text in one part of it.
BLOCK, PART = 64, 4096
MASK = "[SECRET]"


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def before_each(values: Column, merge) -> Column:
    """For each of an array of counts, merge of all before it, from 0 on; made in blocks, whose short arrays alone are appended to."""
    empty = F.expr("cast(array() as array<int>)")

    def scan(block, first):
        start = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def over(blocks):
        return F.flatten(F.zip_with(blocks, scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), merge)), F.lit(0)), scan))

    return let(values, lambda v: let(F.transform(F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(empty), lambda i: F.slice(v, i, BLOCK)), over))


def positions(found: Column, between: Column) -> Column:
    """array<struct<s,e>> of the matches, from the matches and the pieces of text between them."""

    def place(m, start):
        return F.struct(start.alias("s"), (start + F.length(m)).alias("e"))

    def over(f, between):
        before = before_each(F.transform(f, lambda m, i: F.length(F.get(between, i)) + F.length(m)), lambda a, x: a + x)
        return let(before, lambda b: F.transform(f, lambda m, i: place(m, F.get(b, i) + F.length(F.get(between, i)))))

    # bound, or else an optimiser may move the making of both into the functions and do it for each match
    return let(found, lambda f: let(between, lambda x: over(f, x)))


def matched(df: DataFrame) -> DataFrame:
    """Adds, for each kind and for runs, the matches and the text between them (only where there is a match)."""
    patterns = KINDS | {"run": RUNS}
    df = df.select("*", *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    return df.select(
        "*",
        F.when(F.size("m_assign") > 0, F.regexp_extract_all("__text", F.lit(KINDS["assign"]), F.lit(2))).alias("v_assign"),
        *[F.when(F.size(f"m_{k}") > 0, F.split("__text", p, -1)).alias(f"b_{k}") for k, p in patterns.items()],
    )


def runs_of(df: DataFrame) -> DataFrame:
    """Adds runs: array<struct<s, e, encoding, n, p>> of the runs that can be tested."""
    at = positions(F.col("m_run"), F.col("b_run"))
    df = df.select("*", F.zip_with("m_run", at, lambda m, a: F.struct(a["s"].alias("s"), a["e"].alias("e"), m.alias("run"), encoding(m).alias("encoding"))).alias("__all"))
    df = df.withColumn("__all", F.transform(F.filter("__all", lambda r: r["encoding"].isNotNull()), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["encoding"].alias("encoding"), symbols(r["run"], r["encoding"]).alias("body"))))
    long = F.filter("__all", lambda r: F.length(r["body"]) >= by_encoding(r["encoding"], least_length))
    return df.select("*", F.transform(long, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["encoding"].alias("encoding"), F.length(r["body"]).alias("n"), probability(r["body"], r["encoding"]).alias("p"))).alias("runs"))


def least_length(encoding) -> int:
    return max(encoding[3], math.ceil(LEAST_BITS / math.log2(len(encoding[1])) - 1e-9))


def symbols(run: Column, encoding: Column) -> Column:
    """The symbols of a run, without padding and, but for the last encoding, without parting marks."""
    body = F.rtrim(run, F.lit("="))
    return F.when(encoding == len(ENCODINGS) - 1, F.translate(body, "-_", "+/")).otherwise(F.translate(body, "-_", ""))


def encoding(run: Column) -> Column:
    """Index of the inferred encoding, null if there is none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        out = F.when(run.rlike(ENCODINGS[k][2]), F.lit(k)).otherwise(out)
    return out


def by_encoding(encoding: Column, value) -> Column:
    out = F.lit(None)
    for k in reversed(range(len(ENCODINGS))):
        out = F.when(encoding == k, F.lit(value(ENCODINGS[k]))).otherwise(out)
    return out


def probability(body: Column, encoding: Column) -> Column:
    """Three times the least two-sided probability of the three statistics, at most 1."""
    alphabet, k = by_encoding(encoding, lambda e: e[1]), by_encoding(encoding, lambda e: float(len(e[1])))

    def tests(x):
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
        uniform = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = (k - 1) / 2
        turns = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + F.when((y["a"] > middle) != (y["b"] > middle), 1.0).otherwise(0.0))
        turned = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        product = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + (y["a"] - middle) * (y["b"] - middle))
        serial = product / ((k * k - 1) / 12 * F.sqrt(n - 1))
        z = F.greatest(F.abs(uniform), F.abs(turned), F.abs(serial))
        return F.least(F.lit(1.0), 3 * let(z, two_sided))

    return let(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")), tests)


def two_sided(z: Column) -> Column:
    """P(|Z| > z) of a normal Z, z >= 0, by a polynomial of 1 / (1 + 0.2316419 z)."""
    t = 1 / (1 + 0.2316419 * z)
    #: Coefficients of the approximation, error below 1e-7.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def grid(p: Column) -> Column:
    return F.least(F.lit(GRID), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40))) + 1e-9)).cast("int")


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def thresholds(df: DataFrame) -> dict[tuple[int, int], int]:
    """For each stratum (encoding, length class) the first grid cell of rejected probabilities; strata without rejections are absent."""
    counts: dict[tuple[int, int], dict[int, int]] = {}
    rows = df.select(F.inline("runs")).groupBy("encoding", length_class(F.col("n")).alias("length"), grid(F.col("p")).alias("cell")).count()
    for r in rows.collect():
        counts.setdefault((r["encoding"], r["length"]), {})[r["cell"]] = r["count"]
    out = {}
    for stratum, cells in counts.items():
        total, beyond = sum(cells.values()), 0
        for cell in sorted(cells, reverse=True):
            beyond += cells[cell]
            if cell and 10 ** (-cell / 10) <= RATE * beyond / total:
                out[stratum] = cell
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `spans`, array<struct<s, k, e, kind>> in order: k is the place of the kind, base kinds before `random`."""
    df = runs_of(matched(docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))))
    limits = sorted(thresholds(df).items())

    def span(a, k, kind):
        return F.struct(a["s"].alias("s"), F.lit(k).alias("k"), a["e"].alias("e"), F.lit(kind).alias("kind"))

    def secret(r):
        structured = F.lit(False)
        for (e, length), cell in limits:
            structured = structured | ((r["encoding"] == e) & (length_class(r["n"]) == length) & (grid(r["p"]) >= cell))
        return ~structured

    base = []
    for k, kind in enumerate(KINDS):
        at = positions(F.col(f"m_{kind}"), F.col(f"b_{kind}"))
        if kind == "assign":
            at = F.filter(F.zip_with(at, F.coalesce("v_assign", F.expr("cast(array() as array<string>)")), lambda a, v: F.struct(a["s"].alias("s"), a["e"].alias("e"), v.alias("v"))), lambda a: F.length(a["v"]) >= LEAST_VALUE)
        base.append(F.transform(at, lambda a: span(a, k, kind)))
    added = F.transform(F.filter("runs", secret), lambda r: span(r, len(KINDS), "random"))
    df = df.withColumn("__spans", F.array_sort(F.concat(*base, added)))
    # a base span around an added one is before it in order
    reach = before_each(F.transform("__spans", lambda x: F.when(x["k"] < len(KINDS), x["e"]).otherwise(0)), lambda a, x: F.greatest(a, x))
    kept = let(reach, lambda b: F.filter("__spans", lambda x, i: (x["k"] < len(KINDS)) | (F.get(b, i) < x["e"])))
    return df.select(*docs.columns, F.when(F.size(added) > 0, kept).otherwise(F.col("__spans")).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(F.filter("spans", lambda x: x["k"] < len(KINDS))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Pipeline stage: every stretch covered by spans is replaced by MASK, and the length of changed texts is set anew; no row goes."""
    # one column holds the row, so that no name of it can clash
    found = scan(docs.select(F.struct("*").alias("doc"), F.col(text).alias("whole")), "whole")
    whole = F.col("whole")

    def piece(parts, a, b):
        """The text from code point a up to b, from the parts it touches."""
        first, last = F.floor(a / PART), F.floor((b - 1) / PART)
        each = F.transform(F.sequence(first, last), lambda c: F.substring(F.get(parts, c), (F.greatest(a - c * PART, F.lit(0)) + 1).cast("int"), (F.least(b - c * PART, F.lit(PART)) - F.greatest(a - c * PART, F.lit(0))).cast("int")))
        return F.when(a < b, F.array_join(each, "")).otherwise(F.lit(""))

    def cut(parts, reach):
        # a span that begins in the one before only moves the end
        own = F.transform("spans", lambda x, i: F.when(x["s"] >= F.get(reach, i), F.concat(piece(parts, F.get(reach, i), x["s"]), F.lit(MASK))).otherwise(F.lit("")))
        return F.array_join(F.concat(own, F.array(piece(parts, F.array_max(F.transform("spans", lambda x: x["e"])), F.length(whole)))), "")

    reach = before_each(F.transform("spans", lambda x: x["e"]), lambda a, x: F.greatest(a, x))
    new = let(F.regexp_extract_all(whole, F.lit("(?s).{1,%d}" % PART), F.lit(0)), lambda parts: let(reach, lambda r: cut(parts, r)))
    found = found.select("doc", F.size("spans") > 0, F.when(F.size("spans") > 0, new).otherwise(whole)).toDF("doc", "changed", "new")
    out = []
    for f in docs.schema.fields:
        old = F.col("doc").getField(f.name)
        if f.name == text:
            old = F.col("new")
        elif f.name == length:
            old = F.when(F.col("changed"), F.length("new").cast(f.dataType)).otherwise(old)
        out.append(old.alias(f.name))
    return found.select(*out)


def op10_sql() -> str:
    """The DuckDB twin of op10_secrets, from the same patterns, alphabets and limits."""
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in (KINDS | {"run": RUNS}).items()}
    found = []
    for k, (kind, pattern) in enumerate(quoted.items()):
        value = f"regexp_extract_all(x, {pattern}, 2)[i]" if kind == "assign" else "''"
        found.append(
            f"SELECT r, doc_id, {k} AS k, unnest([{{'s': list_sum([length(y) for y in b[1 : i]]) + coalesce(list_sum([length(y) for y in m[1 : i - 1]]), 0), 't': m[i], 'v': {value}}} for i in range(1, len(m) + 1)], recursive := true)"
            f" FROM (SELECT *, regexp_extract_all(x, {pattern}) AS m, string_split_regex(x, {pattern}) AS b FROM d)"
        )
    # DuckDB's patterns have no look-ahead, so each one is a test of its own
    infer = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{e[2][1:-1].rpartition(')')[2]}')" + "".join(f" AND regexp_matches(t, '{x}')" for x in re.findall(r"\(\?=\.\*(\[[^]]*\])\)", e[2])) + f" THEN {k}" for k, e in enumerate(ENCODINGS)) + " END"
    alphabet = "CASE encoding " + " ".join(f"WHEN {k} THEN '{e[1]}'" for k, e in enumerate(ENCODINGS)) + " END"
    least = "CASE encoding " + " ".join(f"WHEN {k} THEN {least_length(e)}" for k, e in enumerate(ENCODINGS)) + " END"
    kinds = "CASE k " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate([*KINDS, "random"])) + " END"
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{kind}" for k, kind in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({" UNION ALL ".join(found)}),
base AS (SELECT r, k, s, s + length(t) AS e FROM found WHERE k < {len(KINDS)} AND (k > 0 OR length(v) >= {LEAST_VALUE})),
guess AS (SELECT r, s, e, encoding, CASE WHEN encoding = {len(ENCODINGS) - 1} THEN translate(rtrim(t, '='), '-_', '+/') ELSE translate(rtrim(t, '='), '-_', '') END AS t FROM (SELECT r, s, s + length(t) AS e, {infer} AS encoding, t FROM found WHERE k = {len(KINDS)})),
symbols AS (SELECT *, length(t) AS n, CAST(length({alphabet}) AS DOUBLE) AS z, [CAST(instr({alphabet}, c) - 1 AS DOUBLE) for c in string_split(t, '')] AS y FROM guess WHERE encoding IS NOT NULL AND length(t) >= {least}),
tests AS (SELECT r, s, e, encoding, n, z, greatest(
    abs((z / n * list_sum([len(list_filter(y, lambda q: q = c)) ** 2 for c in list_distinct(y)]) - n - (z - 1)) / sqrt(2 * (z - 1) * (n - 1) / n)),
    abs((list_sum([CASE WHEN (y[i] > (z - 1) / 2) <> (y[i + 1] > (z - 1) / 2) THEN 1.0 ELSE 0.0 END for i in range(1, n)]) - (n - 1) / 2) / sqrt((n - 1) / 4)),
    abs(list_sum([(y[i] - (z - 1) / 2) * (y[i + 1] - (z - 1) / 2) for i in range(1, n)]) / ((z * z - 1) / 12 * sqrt(n - 1)))) AS w, 1 / (1 + 0.2316419 * w) AS u FROM symbols),
judged AS (SELECT r, s, e, encoding, n, z, CAST(floor(log2(n) + 1e-9) AS INT) AS length_class,
    CAST(least({GRID}, floor(-10 * log10(greatest(least(1, 3 * 2 * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))) * exp(-w * w / 2) / sqrt(2 * pi())), 1e-40)) + 1e-9)) AS INT) AS cell FROM tests),
cells AS (SELECT encoding, length_class, cell, sum(count(*)) OVER (PARTITION BY encoding, length_class ORDER BY cell DESC) AS beyond, sum(count(*)) OVER (PARTITION BY encoding, length_class) AS total FROM judged GROUP BY encoding, length_class, cell),
limits AS (SELECT encoding, length_class, min(cell) AS least_cell FROM cells WHERE cell > 0 AND 10 ** (-cell / 10.0) <= {RATE} * beyond / total GROUP BY encoding, length_class),
added AS (SELECT r, {len(KINDS)} AS k, s, e FROM judged j LEFT JOIN limits USING (encoding, length_class)
    WHERE cell < coalesce(least_cell, {GRID + 1}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = j.r AND b.s <= j.s AND b.e >= j.e)),
spans AS (SELECT *, {kinds} || ':' || s || ':' || e AS w FROM (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM added)),
by_row AS (SELECT r, {counts}, sha256(coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k < {len(KINDS)}), '')) AS base_sha256, string_agg(w, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_row USING (r)
"""
