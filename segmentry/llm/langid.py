"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's score in
a language is the sum, over all ways to cut the word into pieces, of the product of the pieces'
probabilities; a forward pass over the word's positions gives that sum. A text's score is the
product over its words, and the prediction is the language of the largest posterior under a
uniform prior.

Learning is one expectation step: from pieces of equal probability, the expected number of uses
of each piece over all segmentations of all training words (forward and backward passes), summed
per language over all training rows, then smoothed.

Words are maximal runs of letters (Unicode category L), lower-cased, with a mark before the first letter. A letter
that the vocabulary lacks counts as the unknown piece. Runs of up to SIDE_BY_SIDE letters are summed many at a time,
longer ones each on its own with scaled sums; both ways give the same sums, at a cost linear in the letters.

Results for odd rows: null texts, and texts without a letter, get `und` and score 0. Rows whose
lang is null are not learned from. Without any training row every prediction is `und`. Ties go to
the language that sorts first. Repeated rows give equal values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, once, table

MARK = "▁"
#: Most letters of the words that are summed side by side; the sums of a word this long stay within a double's range.
SIDE_BY_SIDE = 24
#: Bytes of text that a worker cuts at one time, unless one text has more.
CUT_BYTES = 4 << 20
#: Added to every expected count.
SMOOTHING = 0.05
UNKNOWN = 0
UNDETERMINED = "und"


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file, lower case or mark only, the unknown piece first; path is read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return ["", *sorted({p for p in pieces if p == p.lower() and p.lstrip(MARK).isalpha() and MARK not in p[1:]} | {MARK})]


class Words:
    """The distinct words of texts, the place of each word in them, and its text."""

    def __init__(self, texts: pa.Array):
        # the first and the last part may be empty, and are no words
        cut = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"\P{L}+")
        flat, text = cut.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.place = coded.indices.to_numpy(zero_copy_only=False)
        self.text = text[real.to_numpy(zero_copy_only=False)]


def in_cuts(batches, text):
    """Batches cut into parts of at most CUT_BYTES bytes of text(batch); a longer text is a part of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(text(batch)), 0).to_numpy(zero_copy_only=False)
        at = held = 0
        for k, n in enumerate(size.tolist()):
            if k > at and held + n > CUT_BYTES:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if batch.num_rows:
            yield batch.slice(at)
        del batch
        give_back()


class Lattice:
    """Forward and backward sums over all segmentations of many words at a time.

    Spans are looked up by a 64-bit polynomial hash of their characters in tables of 2^20 slots;
    pieces that share a slot are in the next table.
    """

    FACTOR, SLOTS = np.uint64(0x9E3779B97F4A7C15), 1 << 20

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.hashes = np.array([self.hash_of(np.array([list(map(ord, p))], np.uint32))[0] if p else 0 for p in pieces], np.uint64)
        self.tables, left, shift = [], np.arange(1, self.size), 44
        while len(left):
            table = np.zeros(self.SLOTS, np.int32)
            slot = (self.hashes[left] >> np.uint64(shift)) & np.uint64(self.SLOTS - 1)
            table[slot] = left
            self.tables.append((np.uint64(shift), table))
            left, shift = left[table[slot] != left], max(shift - 9, 0)

    def hash_of(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k].astype(np.uint64)) * self.FACTOR
            h ^= h >> np.uint64(29)
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The pieces that have the hashes, UNKNOWN where there is none."""
        ids = np.zeros(h.shape, np.int32)
        for shift, table in self.tables:
            got = table[(h >> shift) & np.uint64(self.SLOTS - 1)]
            np.copyto(ids, got, where=(got > 0) & (self.hashes[got] == h))
        return ids

    def pieces_at(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Of one marked word: the piece of the k + 1 characters that begin at i, as ids[i, k], and where there is one."""
        codes = np.array([MARK + word]).view(np.uint32).astype(np.uint64)
        n, ids = len(codes), np.zeros((len(codes), self.longest), np.int32)
        h = np.zeros(n, np.uint64)
        for k in range(min(self.longest, n)):
            h = (h[: n - k] ^ codes[k:]) * self.FACTOR
            h ^= h >> np.uint64(29)
            ids[: n - k, k] = self.look_up(h)
        usable = ids > 0
        usable[:, 0] = True  # a letter without a piece is the unknown one
        return ids, usable

    def scaled_sums(self, ids: np.ndarray, usable: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums a of one word and logs c of their scales, by position: the sum over the first j characters is a[j] * exp(c[j])."""
        n, width = len(ids), self.longest
        a, c = np.zeros((n + 1, model.shape[1])), np.zeros((n + 1, model.shape[1]))
        a[0] = 1
        ends = np.arange(n)[:, None] + 1 + np.arange(width)  # where the spans of each start end
        by_end = np.zeros((n + 1, width), bool)
        i, k = np.nonzero(usable & (ends <= n))
        by_end[i + k + 1, k] = True
        for j in range(1, n + 1):
            k = np.flatnonzero(by_end[j])
            i = j - k - 1
            scale = c[i].max(axis=0)
            total = (a[i] * np.exp(c[i] - scale) * model[ids[i, k]]).sum(axis=0)
            a[j], c[j] = 1, scale + np.log(total)
        return a, c

    def spans(self, words: list[str], n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of words of n letters, marked: (i, j, the words whose characters [i, j) are a piece, those pieces), by j, then i."""
        codes = np.array([MARK + w for w in words], f"<U{n + 1}").view(np.uint32).reshape(len(words), n + 1).astype(np.uint64)
        out = []
        for i in range(n + 1):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(n + 1, i + self.longest) + 1):
                h = (h ^ codes[:, j - 1]) * self.FACTOR
                h ^= h >> np.uint64(29)
                ids = self.look_up(h)
                own = np.arange(len(words)) if j == i + 1 else np.flatnonzero(ids)  # a letter without a piece is the unknown one
                if len(own):
                    out.append((i, j, own, ids[own]))
        return sorted(out, key=lambda s: (s[1], s[0]))

    def log_probability(self, words: list[str], model: np.ndarray) -> np.ndarray:
        """(word, language): log of the sum over segmentations."""
        result = np.empty((len(words), model.shape[1]))
        for n, at in by_length(words):
            if n > SIDE_BY_SIDE:
                for k in at:
                    result[k] = self.scaled_sums(*self.pieces_at(words[k]), model)[1][-1]
                continue
            a = np.zeros((n + 2, len(at), model.shape[1]))
            a[0] = 1
            for i, j, own, ids in self.spans([words[k] for k in at], n):
                a[j, own] += a[i, own] * model[ids]
            result[at] = np.log(a[n + 1])
        return result

    def expected(self, words: list[str], weights: np.ndarray, model: np.ndarray) -> np.ndarray:
        """(piece, column of weights): expected uses of each piece under the piece probabilities; weights: (word, column)."""
        total = np.zeros((self.size, weights.shape[1]))
        for n, at in by_length(words):
            if n > SIDE_BY_SIDE:
                for k in at:
                    used, uses = self.expected_of_one(words[k], model)
                    np.add.at(total, used, uses[:, None] * weights[k])
                continue
            spans = self.spans([words[k] for k in at], n)
            a, b = np.zeros((n + 2, len(at))), np.zeros((n + 2, len(at)))
            a[0] = b[n + 1] = 1
            for i, j, own, ids in spans:
                a[j, own] += a[i, own] * model[ids]
            for i, j, own, ids in sorted(spans, key=lambda s: -s[0]):
                b[i, own] += b[j, own] * model[ids]
            used = np.concatenate([ids for _, _, _, ids in spans])
            uses = np.concatenate([a[i, own] * model[ids] * b[j, own] / a[n + 1, own] for i, j, own, ids in spans])
            word = at[np.concatenate([own for _, _, own, _ in spans])]
            for g in range(weights.shape[1]):
                total[:, g] += np.bincount(used, uses * weights[word, g], self.size)
        return total

    def expected_of_one(self, word: str, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one word, repeats included, and their expected uses."""
        ids, usable = self.pieces_at(word)
        n = len(ids)
        forward = self.scaled_sums(ids, usable, model[:, None])[1][:, 0]
        # the backward sums are the forward sums of the word from its end
        i, k = np.nonzero(usable & (np.arange(n)[:, None] + 1 + np.arange(self.longest) <= n))
        back_ids, back = np.zeros_like(ids), np.zeros_like(usable)
        back_ids[n - (i + k + 1), k], back[n - (i + k + 1), k] = ids[i, k], True
        backward = self.scaled_sums(back_ids, back, model[:, None])[1][::-1, 0]
        used = ids[i, k]
        return used, np.exp(forward[i] + np.log(model[used]) + backward[i + k + 1] - forward[n])


def by_length(words: list[str]):
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        for at in range(0, len(own), 8192):
            yield int(size[own[0]]), own[at : at + 8192]


def learn(train: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (piece, language) of piece probabilities.

    Every training row counts. Workers turn the words of a cut into piece counts, so what is shuffled
    is at most pieces x languages numbers a task, and what the driver gets that many in all.
    """
    shared = train.sparkSession.sparkContext.broadcast(pieces)
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches):
        lattice = Lattice(shared.value)
        flat = np.full(lattice.size, 1 / lattice.size)
        totals: dict[str, np.ndarray] = {}
        for part in in_cuts(batches, lambda b: b.column(0)):
            words, of = Words(part.column(0)), part.column(1).dictionary_encode()
            n = len(of.dictionary)
            pairs, times = np.unique(words.place.astype(np.int64) * n + of.indices.to_numpy(zero_copy_only=False)[words.text], return_counts=True)
            weights = np.zeros((len(words.distinct), n))
            weights[pairs // n, pairs % n] = times
            for lang, uses in zip(of.dictionary.to_pylist(), lattice.expected(words.distinct, weights, flat).T):
                totals[lang] = totals.get(lang, 0) + uses
        give_back()
        for g, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], schema=schema)

    rows = train.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    model = np.full((len(pieces), len(langs)), SMOOTHING)
    model[rows["piece"].to_numpy(int), [langs.index(g) for g in rows["lang"]]] += rows["n"].to_numpy()
    return langs, model / np.maximum(model.sum(axis=0), 1e-300)


class Scorer:
    """Predictions for arrays of texts."""

    def __init__(self, pieces: list[str], langs: list[str], model: np.ndarray):
        self.lattice, self.langs, self.model = Lattice(pieces), langs, model

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        words = Words(texts)
        each = self.lattice.log_probability(words.distinct, self.model)
        total = [np.bincount(words.text, column[words.place], len(texts)) for column in each.T]
        best, score = [], []
        for n, row in zip(np.bincount(words.text, minlength=len(texts)).tolist(), np.stack(total, axis=1) if total else np.zeros((len(texts), 0))):
            if not (n and self.langs):
                best.append(UNDETERMINED)
                score.append(0.0)
                continue
            k = int(row.argmax())
            best.append(self.langs[k])
            score.append(float(1 / np.exp(row - row[k]).sum()))
        return best, score


def predict(df: DataFrame, pieces: list[str], langs: list[str], model: np.ndarray, text: str = "text", passed: tuple[str, ...] = ("doc_id",), inside: int | None = None) -> DataFrame:
    """The passed columns, then lang_pred and score (the posterior of lang_pred).

    inside: the place of the text among the fields of the last passed column, a struct, so that the text is sent to the workers once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = df.sparkSession.sparkContext.broadcast((pieces, langs, model))
    types = df.select(*passed).schema
    schema = pa.schema([*to_arrow_schema(types), ("lang_pred", pa.string()), ("score", pa.float64())])
    key = "langid", hashlib.sha256(repr((pieces, langs)).encode() + model.tobytes()).hexdigest()

    def texts(batch):
        last = batch.column(batch.num_columns - 1)
        return last if inside is None else pc.struct_field(last, [inside])

    def run(batches):
        scorer = once(key, lambda: Scorer(*shared.value))
        for batch in in_cuts(batches, texts):
            best, score = scorer(texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(best, pa.string()), pa.array(score, pa.float64())], schema=schema)

    from pyspark.sql import types as T

    out = T.StructType([*types.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    own = [] if inside is not None else [F.col(text).alias("__text")]
    return df.select(*passed, *own).mapInArrow(run, out)


def vocabulary() -> str:
    """File of the pieces that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out():
    return fold("doc_id", 4) == 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = read_pieces(vocabulary())
    langs, model = learn(docs.where(~held_out()), pieces)
    return predict(docs.withColumn("held_out", held_out()), pieces, langs, model, passed=("doc_id", "held_out"))


def reject(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents whose language can be told; those without letters, or with a posterior below least, go."""
    pieces = read_pieces(vocabulary())
    langs, model = learn(docs.where(~held_out()), pieces)
    # one column holds the row, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("doc"))
    out = predict(rows, pieces, langs, model, passed=("doc",), inside=docs.columns.index("text"))
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc.*")
