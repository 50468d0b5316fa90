"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled training texts: words, and beginnings of words, that are far
likelier in toxic texts. It is a trie; a word is matched by the product of the trie and a
Levenshtein automaton (one edit from EDITS_1 letters on, two from EDITS_2 on, none for beginnings).
The product is made deterministic as words need it, so a word costs one table look-up a letter.
Variants that are themselves words of clean texts are exceptions.

Each match is weighted by its context, WINDOW tokens either side: quoted or reported matches weigh
less, matches addressed to a reader more. A logistic model over sums, counts, density and the
strongest window gives the score. It, and the lexicon, are fitted on at most TRAIN_ROWS labelled rows of
the training folds, chosen by a hash of the id; near copies among them count once.

Results for odd rows: null and empty texts have no match and get the score of a text without
matches; repeated rows give equal values; a doc_id labelled twice is toxic if one label is; without
labelled training rows, or with one class only, there is no lexicon and the score is the smoothed toxic share.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, keep, once, per_slice, table

#: Bound of the labelled sample.
TRAIN_ROWS = 20_000
#: Bound of the lexicon.
LEXICON = 2_000
SUPPORT, LEAST_ODDS = 6, 2.5
STEMS = (4, 9)
EDITS_1, EDITS_2 = 5, 9
WINDOW = 6
REMEMBERED = 400_000
REACH = 12
QUOTES = re.compile("[\"'‘-‟«»‹›]")
#: Words that report speech, and words that address a reader: fixed values.
REPORTING = frozenset("said says say quote quoted quotes quoting called wrote writes word words term phrase sagte schrieb zitat wort disait écrit mot citation dijo escribió palabra cita".split())
ADDRESSING = frozenset("you your youre u ur du dich dir dein deine ihr tu te toi ton ta vous votre usted ustedes tú ti eres".split())

word_runs = re.compile(r"\w+").findall


class Lexicon:
    """Deterministic product of a trie of entries and Levenshtein automata."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions: frozenset[str]):
        self.exceptions = exceptions
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.edits: list[int] = [0]
        for entries, kind in ((words, 0), (stems, 1)):
            for w, weight in entries.items():
                k = 0
                # a node's edits: the most that an entry below it allows
                allowed = 0 if kind else (len(w) >= EDITS_1) + (len(w) >= EDITS_2)
                for c in w:
                    self.edits[k] = max(self.edits[k], allowed)
                    if c not in self.children[k]:
                        self.children[k][c] = len(self.children)
                        self.children.append({})
                        self.weight.append(0.0)
                        self.stem.append(0.0)
                        self.edits.append(0)
                    k = self.children[k][c]
                self.edits[k] = max(self.edits[k], allowed)
                (self.stem if kind else self.weight)[k] = weight
        self.own_edits = {w: (len(w) >= EDITS_1) + (len(w) >= EDITS_2) for w in words}
        self.depth_edits: dict[int, int] = {}
        for w in words:
            k = 0
            for c in w:
                k = self.children[k][c]
            self.depth_edits[k] = self.own_edits[w]
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int]] = []
        self.start = self.state({0: 0})

    def state(self, at: dict[int, int]) -> int:
        """Number of the state of trie nodes with their fewest edits, closed under skipped letters of entries."""
        todo = list(at)
        while todo:
            k = todo.pop()
            for child in self.children[k].values():
                e = at[k] + 1
                if e <= self.edits[child] and e < at.get(child, 9):
                    at[child] = e
                    todo.append(child)
        key = frozenset(at.items())
        if key not in self.states:
            best = max(((self.weight[k], -e) for k, e in key if self.weight[k] and e <= self.depth_edits[k]), key=lambda x: (x[1], x[0]), default=(0.0, 0))
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append((best[0], -best[1]))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for k, e in self.sets[state]:
            child = self.children[k].get(c)
            if child is not None and e < at.get(child, 9):
                at[child] = e
            if e + 1 <= self.edits[k] and e + 1 < at.get(k, 9):
                at[k] = e + 1
            for other, to in self.children[k].items():
                if other != c and e + 1 <= self.edits[to] and e + 1 < at.get(to, 9):
                    at[to] = e + 1
        to = self.state(at) if at else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best entry, weight 0 if there is none."""
        if len(self.sets) > 100_000:
            self.reset()
        k = 0
        for c in word:
            k = self.children[k].get(c, -1)
            if k < 0:
                break
            if self.stem[k]:
                return self.stem[k], 0
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return 0.0, 0
        weight, edits = self.accepts[state]
        return (0.0, 0) if weight and edits and word in self.exceptions else (weight, edits)


class Scorer:
    """Features of texts under a lexicon."""

    def __init__(self, words, stems, exceptions):
        self.lexicon = Lexicon(words, stems, frozenset(exceptions))
        self.known: dict[str, tuple[float, int] | None] = {}

    def token(self, token: str) -> tuple[float, int] | None:
        found = [m for m in map(self.lexicon.match, word_runs(token.lower())) if m[0]]
        return max(found) if found else None

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = self.token(t)
        hits = [(k, m) for k, m in enumerate([known[t] for t in tokens]) if m]
        if len(known) > REMEMBERED:
            known.clear()
        if not hits:
            return [0.0] * 7
        weights, quoted, fuzzy, places = [], 0, 0, []
        for k, (w, edits) in hits:
            before, after = tokens[max(0, k - WINDOW) : k], tokens[k + 1 : k + 1 + WINDOW]
            words = {x for t in before + after for x in word_runs(t.lower())}
            inside = (any(map(QUOTES.match, before)) or QUOTES.match(tokens[k])) and (any(QUOTES.search(t[1:]) for t in after) or QUOTES.search(tokens[k][1:]))
            reported, addressed = bool(inside) or bool(words & REPORTING), bool(words & ADDRESSING)
            quoted += reported and not addressed
            fuzzy += edits > 0
            weights.append(w * (0.7**edits) * (1.25 if addressed else 0.3 if reported else 1.0))
            places.append(k)
        total, strongest, low, run = sum(weights), 0.0, 0, 0.0
        for high, p in enumerate(places):
            run += weights[high]
            while places[low] < p - REACH:
                run -= weights[low]
                low += 1
            strongest = max(strongest, run)
        return [math.log1p(total), math.log1p(len(hits)), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * total / len(tokens)), math.log1p(strongest), max(weights) / 10]


def sample(docs: DataFrame, labels: DataFrame, label: str, train) -> DataFrame:
    """(doc_id, text, y, sketch): at most TRAIN_ROWS labelled rows of the training folds, by a hash of the id."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32()), ("sketch", pa.int64())])

    def f(ids, texts, ys):
        import xxhash

        def sketch(t):
            words = (t or "").split()
            hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))]
            # two minima: texts that share both are copies, or nearly
            return (min(hashes) ^ min(h * 0x9E3779B97F4A7C15 % (1 << 64) for h in hashes) * 3) % (1 << 63)

        return [ids, texts, ys, list(map(sketch, texts))]

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    found = rows.mapInArrow(per_slice(lambda: f, schema), "doc_id long, text string, y int, sketch long")
    # one text for each group of copies, whatever their order, with the label of most of them
    first = F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), "doc_id", "text")).alias("first")
    return keep(found.groupBy("sketch").agg(first, F.round(F.avg("y")).cast("int").alias("y")).select("first.doc_id", "first.text", "y"))


def learn_lexicon(rows: DataFrame) -> tuple[dict, dict, list]:
    """Words and beginnings with their log-odds, and the exceptions."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        counts = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in word_runs((t or "").lower()) if w.isalpha() and len(w) <= 24}
                counts.update((w, False, y) for w in words)
                counts.update({(w[:n], True, y) for w in words for n in range(STEMS[0], min(STEMS[1], len(w)) + 1)})
        keys = list({k[:2] for k in counts})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k + (1,)] for k in keys], pa.int64()), pa.array([counts[k + (0,)] for k in keys], pa.int64())], schema=schema)

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, {}, []
    terms = keep(rows.select("text", "y").mapInArrow(run, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    terms = terms.withColumn("odds", odds)
    best = terms.where((F.col("toxic") >= SUPPORT) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("odds"), "stem", "term").limit(4 * LEXICON).collect()
    words = {r["term"]: (r["odds"], r["toxic"]) for r in best if not r["stem"]}
    stems: dict[str, float] = {}
    for r in sorted((r for r in best if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        p = r["term"]
        covered = any(p[:n] in stems for n in range(STEMS[0], len(p)))
        # a beginning that is mostly one word is left to that word
        if not covered and max((n for w, (_, n) in words.items() if w.startswith(p)), default=0) < 0.5 * r["toxic"]:
            stems[p] = r["odds"]
    words = {w: o for w, (o, _) in sorted(words.items(), key=lambda x: (-x[1][0], x[0])) if not any(w[:n] in stems for n in range(STEMS[0], len(w) + 1))}
    words = dict(list(words.items())[:LEXICON])
    lexicon = words, stems

    def near(batches):
        matcher = Lexicon(*lexicon, frozenset())
        for batch in batches:
            hit = [w for w in batch.column(0).to_pylist() if matcher.match(w)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], names=["term"])

    exceptions = terms.where("not stem and clean >= 2 and odds < 1").select("term").mapInArrow(near, "term string").collect()
    return words, stems, sorted(r["term"] for r in exceptions)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model (the last is the intercept, which isn't penalised) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([*[penalty] * (x.shape[1] - 1), 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train, label: str = "toxic") -> tuple:
    rows = sample(docs, labels, label, train)
    words, stems, exceptions = learn_lexicon(rows)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def make():
        scorer = Scorer(words, stems, exceptions)
        return lambda texts, ys: [ys, list(map(scorer.features, texts))]

    got = rows.select("text", "y").mapInArrow(per_slice(make, schema), "y int, x array<double>").toPandas()
    y = got["y"].to_numpy(float)
    if not words and not stems:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return words, stems, exceptions, np.array([0.0] * 7 + [math.log(share / (1 - share))])
    return words, stems, exceptions, fit_logistic(np.array(got["x"].tolist()), y)


def score(docs: DataFrame, model: tuple, passed: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches (log) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = "toxicity", hashlib.sha256(repr((model[:3], model[3].tolist())).encode()).hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def make():
        scorer, w = once(key, lambda: Scorer(*shared.value[:3])), shared.value[3]

        def f(ids, held, texts):
            x = np.array([scorer.features(t) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            return [ids, held, p.tolist(), (p >= 0.5).astype(int).tolist()]

        return f

    return docs.select(*passed, "text").mapInArrow(per_slice(make, schema), "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model)
