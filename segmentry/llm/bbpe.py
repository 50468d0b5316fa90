"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Bytes are written as characters (the usual printable table), so that a model over strings can
merge bytes; decoding reverses the table and joins bytes before any UTF-8 is read, so a
character that is split between two tokens comes back whole.

Results for odd rows: a null text counts as empty; an empty text has no tokens; repeated rows
give equal values; other columns of the input never matter.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import once, per_slice, table

#: Largest number of distinct pre-tokens that a worker remembers.
REMEMBERED = 400_000
#: Pre-tokens in one call of the library.
TOGETHER = 64
#: Pre-tokens longer than this are encoded anew each time.
LONGEST_REMEMBERED = 48
#: The usual pattern of pre-tokens, and an equal one of the faster re module for texts without the characters of ODD.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: All but ASCII (without the separators 1C to 1F) and the Latin letters up to U+024F.
ODD = "[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]"


def byte_characters() -> list[str]:
    """Character of each byte: printable Latin-1 bytes stand for themselves, the rest for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank table; pattern splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_characters()
        as_text = dict(enumerate(chars))
        write = lambda raw: raw.decode("latin-1").translate(as_text)
        vocab = {write(token): rank for token, rank in ranks.items()}
        merges = [(write(token[:k]), write(token[k:])) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.write, self.split = write, regex.compile(pattern).findall
        if pattern == GPT2_PATTERN:
            slow, plain, odd = self.split, re.compile(PLAIN_PATTERN).findall, re.compile(ODD).search
            self.split = lambda text: slow(text) if odd(text) else plain(text)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {rank: bytes(self.byte_of[c] for c in token) for token, rank in vocab.items()}
        #: Bytes of a token by its id as written, and ids of pre-tokens, joined by commas.
        self.written_bytes = {str(rank): own for rank, own in self.token_bytes.items()}
        self.known: dict[str, str] = {}

    def ids(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each pre-token."""
        out: list[list[int]] = [[] for _ in pieces]
        for at in range(0, len(pieces), TOGETHER):
            # the characters of the byte table hold no white space, so a space can part the pre-tokens
            got = self.model.encode(" ".join([self.write(p.encode()) for p in pieces[at : at + TOGETHER]]), add_special_tokens=False)
            for k, i in zip(got.word_ids, got.ids):
                out[at + k].append(i)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def summaries(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text: its ids joined by commas, their number, and the decoded bytes."""
        known, split = self.known, [self.split(t) for t in texts]
        new = {p for pieces in split for p in pieces}.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {p for pieces in split for p in pieces}
        new = list(new)
        for piece, ids in zip(new, self.ids(new)):
            known[piece] = ",".join(map(str, ids))
        out = []
        for pieces in split:
            joined = ",".join([known[p] for p in pieces])
            ids = joined.split(",") if pieces else []
            out.append((joined, len(ids), b"".join(map(self.written_bytes.__getitem__, ids))))
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        return out

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, and for each token the code points [start, end) it touches; a character split between tokens belongs to each."""
        pieces = self.split(text)
        ids = [i for piece in self.ids(pieces) for i in piece] if pieces else []
        owner = [k for k, c in enumerate(text) for _ in range(len(c.encode()))]
        starts, ends, at = [], [], 0
        for i in ids:
            width = len(self.token_bytes[i])
            starts.append(owner[at])
            ends.append(owner[at + width - 1] + 1)
            at += width
        return ids, starts, ends


def codec_from(path: str, pattern: str):
    """A function that builds the codec in a worker; the rank file is read here, on the driver."""
    ranks = read_ranks(path)
    key = "bbpe", hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return ranks, pattern, key


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, ids, starts, ends): tokens of every text with the code points they cover; path is a file of ranks."""
    shared = df.sparkSession.sparkContext.broadcast(codec_from(path, pattern))

    def make():
        ranks, pat, key = shared.value
        codec = once(key, lambda: Codec(ranks, pat))

        def f(ids, texts):
            return [ids, *zip(*[codec.encode(t or "") for t in texts])]

        return f

    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    return df.select(id_column, text).mapInArrow(per_slice(make, schema), f"id long, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """(id, decoded binary): the bytes of every array of token ids."""
    shared = df.sparkSession.sparkContext.broadcast(codec_from(path, pattern))

    def make():
        ranks, pat, key = shared.value
        codec = once(key, lambda: Codec(ranks, pat))
        return lambda keys, lists: [keys, [codec.decode(x or []) for x in lists]]

    schema = pa.schema([("id", pa.int64()), ("decoded", pa.binary())])
    return df.select(id_column, ids).mapInArrow(per_slice(make, schema), "id long, decoded binary").withColumnRenamed("id", id_column)


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: it is encoded, and the ids are decoded again."""
    shared = df.sparkSession.sparkContext.broadcast(codec_from(path, pattern))

    def make():
        ranks, pat, key = shared.value
        codec = once(key, lambda: Codec(ranks, pat))

        def f(ids, texts):
            got = codec.summaries([t or "" for t in texts])
            return [ids, [g[1] for g in got], [hashlib.sha256(g[0].encode()).hexdigest() for g in got], [hashlib.sha256(g[2]).hexdigest() for g in got]]

        return f

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return df.select("doc_id", "text").mapInArrow(per_slice(make, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    """File of ranks and pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), *vocabulary())
