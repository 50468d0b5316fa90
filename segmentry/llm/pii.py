"""Information-theoretic sanitisation of personal data.

Protected entities are the base findings (see KINDS). Over the corpus, the co-occurrence of a term
t with an entity e in whole documents says how far t gives e away: the share of the documents with t that
hold e, and the pointwise mutual information of both in bits. Pairs with SUPPORT or more different contexts, a
share of at least SHARE and at least GENERALISE bits are disclosing: in every document that holds that entity
all places of the term become spans of kind `term`. The contexts of an entity are the sets of terms within NEAR
tokens on either side of it; a document adds those with the term in them, or else one. `sanitise` puts a placeholder for base findings, generalises
disclosing terms, and removes those of REMOVE bits or more.

Document counts of terms are taken over all documents, for the terms that can still be disclosing: counts in a part of
the documents bound the whole counts from below, and a pair that fails with the bound fails with the whole count, so no
result depends on the part. A worker counts wanted terms only, as a set if their number is within BROADCAST_TERMS, else by a join.

Results for odd rows: a null text counts as empty; empty texts have no spans, and base_sha256 is that of the
empty string; every input row gives one row (a null doc_id too). Equal contexts, as in exact copies, count as one
context, so copies alone disclose nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, keep, per_slice, small_or_not, table

KINDS = ("email", "ip", "card", "phone")
NEAR = 8
SUPPORT, SHARE = 2, 0.5
GENERALISE, REMOVE = 3.0, 8.0
BROADCAST_TERMS = 500_000
#: One in so many documents is read for the first lower bounds of term counts.
FIRST_LOOK = 16
#: Distinct raw tokens that a counting worker remembers.
REMEMBERED = 400_000

domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
local = re.compile(r"[A-Za-z0-9._%+-]")
ips = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
cards = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
phones = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
digit = re.compile("[0-9]").search
tokens_in = re.compile(r"\S+").finditer
LEAD = re.compile(r"^[\W_]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """(start, end), leftmost and not overlapping; each address is found from its @, so long words cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and local.match(text, start - 1):
            start -= 1
        m = domain(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if digit(text):
        out += [(m.start(), 1, m.end()) for m in ips(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
        for m in cards(text):
            if m.end() - m.start() >= 14:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in phones(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def term_of(token: str) -> str:
    """The term of a token, empty if it is none: edges without marks, lower case, three letters or more."""
    term = EDGES.sub("", token).lower()
    return term if len(term) >= 3 and any(c.isalpha() for c in term) else ""


def merged(spans: list[tuple[int, int, int]]):
    """overlaps(a, b) of the spans, sorted, in one look."""
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    return lambda a, b: bool((k := bisect_left(starts, b)) and ends[k - 1] > a)


def windows(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For every base span its entity, a hash of its context, and the terms near it."""
    import xxhash

    if not spans:
        return []
    tokens, overlaps, terms = [m.span() for m in tokens_in(text)], merged(spans), {}
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]

    def term_at(k):
        if k not in terms:
            a, b = tokens[k]
            terms[k] = "" if overlaps(a, b) else term_of(text[a:b])
        return terms[k]

    out = []
    for s, k, e in spans:
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        near = [t for i in (*range(max(0, before - NEAR), before), *range(after, min(len(tokens), after + NEAR))) if (t := term_at(i))]
        value = text[s:e].lower() if k < 2 else "".join(c for c in text[s:e] if c.isdigit())
        context = xxhash.xxh64_intdigest("\n".join(sorted(set(near)))) - (1 << 63)
        out.append({"e": f"{KINDS[k]}:{value}", "ctx": context, "terms": near})
    return out


def places(text: str, spans: list[tuple[int, int, int]], known: dict[str, str]) -> dict[str, list[tuple[int, int]]]:
    """The places of every term of the text outside base spans; known remembers terms of tokens."""
    out: dict[str, list[tuple[int, int]]] = {}
    if len(known) > REMEMBERED:
        known.clear()
    overlaps = merged(spans)
    for m in tokens_in(text):
        token, (a, b) = m.group(), m.span()
        if (t := known.get(token)) is None:
            t = known[token] = term_of(token)
        if t and not overlaps(a, b):
            lead = len(token) - len(LEAD.sub("", token))
            out.setdefault(t, []).append((a + lead, a + lead + len(EDGES.sub("", token))))
    return out


WINDOWS = "array<struct<e:string,ctx:long,terms:array<string>>>"
SPANS = "array<struct<s:int,k:int,x:int,kind:string>>"


def base(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(row, doc_id, base array<struct<s,k,x,kind>>, windows, held) of every row; row numbers the rows, held is the text if it has findings."""
    span = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("x", pa.int32()), ("kind", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("windows", pa.list_(pa.struct([("e", pa.string()), ("ctx", pa.int64()), ("terms", pa.list_(pa.string()))]))), ("held", pa.string())])

    def f(ids, texts):
        found = [base_spans(t or "") for t in texts]
        return [ids, [[{"s": s, "k": k, "x": e, "kind": KINDS[k]} for s, k, e in x] for x in found], [windows(t or "", x) for t, x in zip(texts, found)], [t if x else None for t, x in zip(texts, found)]]

    out = docs.select(F.col(id_column).cast("long"), text).mapInArrow(per_slice(lambda: f, schema), f"doc_id long, base {SPANS}, windows {WINDOWS}, held string")
    return keep(out.withColumn("row", F.monotonically_increasing_id()))


def term_counts(texts: DataFrame, terms: DataFrame, plain: bool) -> DataFrame:
    """(t, n): how many of the texts, a table of one column, hold each of the terms; terms: (t), distinct and kept. Where plain is set, texts with findings don't count."""
    few = terms.count() <= BROADCAST_TERMS
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(r["t"] for r in terms.collect()) if few else None)
    schema = pa.schema([("t", pa.string()), ("n", pa.int64())])

    def run(batches):
        from collections import Counter

        only, counts, hits, seen = wanted.value, Counter(), {}, set()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    if not text or plain and base_spans(text):
                        continue
                    tokens = set(text.split())
                    for token in tokens - seen:
                        if (t := term_of(token)) and (only is None or t in only):
                            hits[token] = t
                    seen |= tokens
                    counts.update({hits[x] for x in tokens & hits.keys()})
                if len(seen) > REMEMBERED:
                    seen.clear()
                    hits.clear()
                if len(counts) > REMEMBERED:
                    yield emit()
        yield emit()
        give_back()

    counted = texts.mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return counted if few else counted.join(terms, "t", "left_semi")


def able_entities(found: DataFrame) -> DataFrame:
    """(e): the entities of SUPPORT or more contexts; one of fewer is in no supported pair."""
    near = found.select(F.inline("windows"))
    return keep(near.groupBy("e").agg(F.count_distinct("ctx").alias("contexts")).where(F.col("contexts") >= SUPPORT).select("e"))


def pairs_of(found: DataFrame, able: DataFrame) -> DataFrame:
    """(row, e, t, ctx, first): every term of a document with every entity in it of SUPPORT or more contexts; first is 1 once for each row, e and t.

    Every term of such a document has a row with a null e too.
    """
    near = found.select("row", F.inline("windows"))
    by_row = near.join(small_or_not(able, able.count()), "e").groupBy("row").agg(F.collect_list(F.struct("e", "ctx", "terms")).alias("windows"))
    schema = pa.schema([("row", pa.int64()), ("e", pa.string()), ("t", pa.string()), ("ctx", pa.int64()), ("first", pa.int64())])

    def run(batches):
        known, out = {}, []

        def emit():
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for at in range(batch.num_rows):
                row, spans, text, found = (c.slice(at, 1).to_pylist()[0] for c in batch.columns)
                terms = places(text, [(x["s"], x["k"], x["x"]) for x in spans], known)
                least, near = {}, {}
                for w in found:
                    least[w["e"]] = min(w["ctx"], least.get(w["e"], w["ctx"]))
                    for t in w["terms"]:
                        near.setdefault((w["e"], t), set()).add(w["ctx"])
                out += [(row, None, t, 0, 1) for t in terms]
                for e, ctx in least.items():
                    for t in terms:
                        for k, c in enumerate(near.get((e, t)) or (ctx,)):
                            out.append((row, e, t, c, int(not k)))
                    if len(out) > 50_000:
                        yield emit()
        yield emit()

    return found.select("row", "base", "held").join(by_row, "row").mapInArrow(run, "row long, e string, t string, ctx long, first long")


def disclosing(docs: DataFrame, found: DataFrame, able: DataFrame, text: str = "text") -> DataFrame:
    """(e, t, bits): the pairs whose term gives the entity away.

    The documents that hold a term are counted in three parts: those with an able entity while their pairs are made,
    then, for the terms that can still be disclosing, those with other findings only and those without any.
    """
    entities = found.select("row", F.inline("windows")).select("e", "row").distinct()
    n_e = entities.groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = pairs_of(found, able).groupBy("e", "t", "ctx").agg(F.sum("first").alias("n"))
    pairs = keep(pairs.groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts")).where((F.col("contexts") >= SUPPORT) | F.col("e").isNull()))
    n = found.count()
    bits = F.log2(F.col("n_te").cast("double") * n / (F.col("n_t") * F.col("n_e")))

    def giving(df):
        return df.where((F.col("n_te") >= SHARE * F.col("n_t")) & (bits >= GENERALISE))

    # A term is in no fewer documents than those seen so far, so pairs that fail with this number fail with the whole one.
    # Common words fail after a look at a part of the documents; only for the others are all documents counted.
    seen = keep(giving(pairs.where("e is not null").join(n_e, "e").join(pairs.where("e is null").select("t", F.col("n_te").alias("n_t")), "t")))
    able_rows = keep(entities.join(small_or_not(able, able.count()), "e").select("row").distinct())
    others = found.where("held is not null").join(small_or_not(able_rows, able_rows.count()), "row", "left_anti").select("held")
    part = F.pmod(F.xxhash64("doc_id", text), F.lit(FIRST_LOOK)) == 0 if "doc_id" in docs.columns else F.pmod(F.xxhash64(text), F.lit(FIRST_LOOK)) == 0

    def with_counts(seen, *counted):
        terms = keep(seen.select("t").distinct())
        more = [term_counts(texts, terms, plain) for texts, plain in counted]
        more = reduce(DataFrame.unionByName, more).groupBy("t").agg(F.sum("n").alias("n"))
        return seen.join(more, "t", "left").withColumn("n_t", F.col("n_t") + F.coalesce("n", F.lit(0))).drop("n")

    seen = keep(giving(with_counts(seen, (docs.where(part).select(text), True), (others, False))))
    whole = with_counts(seen, (docs.where(~part).select(text), True))
    return keep(giving(whole).select("e", "t", bits.alias("bits")))


def find(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): spans in order, array<struct<s,k,x,kind,bits>>, base findings and disclosing terms."""
    found = base(docs, text, id_column)
    able = able_entities(found)
    pairs = disclosing(docs, found, able, text)
    terms = pairs_of(found, able).where("first = 1").select("row", "e", "t").join(small_or_not(pairs, pairs.count()), ["e", "t"]).groupBy("row", "t").agg(F.max("bits").alias("bits"))
    terms = terms.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("t", "bits"))).alias("bits"))
    span = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("x", pa.int32()), ("kind", pa.string()), ("bits", pa.float64())])
    schema = pa.schema([("row", pa.int64()), ("terms", pa.list_(span))])

    def make():
        known = {}

        def f(rows, spans, texts, bits):
            out = []
            for own, t, b in zip(spans, texts, bits):
                b = dict(b)
                at = places(t, [(x["s"], x["k"], x["x"]) for x in own], known)
                out.append([{"s": s, "k": len(KINDS), "x": e, "kind": "term", "bits": b[t]} for t in b for s, e in at[t]])
            return [rows, out]

        return f

    terms = found.select("row", "base", "held").join(terms, "row").mapInArrow(per_slice(make, schema), "row long, terms array<struct<s:int,k:int,x:int,kind:string,bits:double>>")
    own = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["x"].alias("x"), b["kind"].alias("kind"), F.lit(None).cast("double").alias("bits")))
    return found.join(terms, "row", "left").select("doc_id", "base", F.array_sort(F.when(F.col("terms").isNull(), own).otherwise(F.concat(own, "terms"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda b: F.concat_ws(":", b["kind"], b["s"].cast("string"), b["x"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def sanitised(text: str, spans: list[tuple[int, int, int, float | None]]) -> str:
    """The text with placeholders for base findings, generalised terms, and without terms of REMOVE bits or more."""
    out, at = [], 0
    for s, k, e, bits in sorted(spans, key=lambda x: x[:3]):
        if s >= at:
            out.append(text[at:s])
            if k < len(KINDS):
                out.append(f"[{KINDS[k].upper()}]")
            elif (bits or 0) < REMOVE:
                out.append("[NAME]" if text[s].isupper() else "[TERM]")
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sanitised texts, a row for each row; the other columns stay as they are."""
    # one column holds the row, so that no name of it can clash
    rows = keep(docs.select(F.struct("*").alias("doc"), F.col(text).alias("whole"), F.monotonically_increasing_id().alias("row")))
    found = find(rows, "whole", "row").where(F.size("spans") > 0).select(F.col("doc_id").alias("found"), "spans")

    def run(batches):
        for batch in batches:
            new = [t if not spans else sanitised(t, [(x["s"], x["k"], x["x"], x["bits"]) for x in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc", "new"])

    whole = rows.join(found, F.col("row") == F.col("found"), "left").select("doc", "whole", "spans")
    made = whole.mapInArrow(run, T.StructType([*rows.select("doc").schema.fields, T.StructField("new", T.StringType())]))
    return made.select(*[(F.col("new") if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
