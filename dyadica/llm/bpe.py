"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte is shown as one printable character, each ranked byte string as a piece of those characters with score -rank,
so that sentencepiece's merges (highest score first, then leftmost) are the rank file's. The model has identity
normalisation, no dummy prefix and no special treatment of spaces. Texts are split by the pre-token pattern; a pre-token
that is itself ranked is that one id, others are encoded by sentencepiece. Decoding maps ids back to bytes.

Defined results: a null or empty text has no ids; ids decode to exactly the text's UTF-8 bytes; a null list of ids
decodes to no bytes; an id that is not in the vocabulary raises KeyError. Equal rows get equal results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table, written

CACHED = 200_000  # encodings that a worker keeps


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for every byte; no space or control character among them."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b if b in set(shown) else 256 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """A protobuf field: int, float, str, bytes or (as bytes) message."""
    import struct

    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised ModelProto; a piece's id is its rank, and one more id is the unknown piece."""
    show = byte_characters()
    by_rank = sorted(vocabulary.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    pieces = b"".join(_field(1, _field(1, "".join(show[b] for b in piece)) + _field(2, -float(rank)) + _field(3, 1)) for piece, rank in by_rank)
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # BPE; no other special pieces
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    def __init__(self, vocabulary: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(vocabulary))
        self.vocabulary, self.show, self.cache = vocabulary, byte_characters(), {}

    def _new(self, token: str) -> list[int]:
        raw = token.encode()
        rank = self.vocabulary.get(raw)
        ids = [rank] if rank is not None else self.pieces.encode("".join([self.show[b] for b in raw]), num_threads=1)
        if len(token) < 64:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, new, extend = self.cache.get, self._new, out.extend
        for token in self.find(text or ""):
            extend(get(token) or new(token))
        return out


def encoder(spark: SparkSession, path: str, pattern: str):
    """A function from a text column to its column of ids (array of int). path: a rank file, read on the driver."""
    vocabulary = ranks(path)
    shared = spark.sparkContext.broadcast((vocabulary, sentencepiece_model(vocabulary), pattern))  # as large as the rank file

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, model, pattern = shared.value
        own = Encoder(vocabulary, pattern, model)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """A function from a column of ids to the bytes they stand for."""
    shared = spark.sparkContext.broadcast({i: b for b, i in ranks(path).items()})

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = shared.value.__getitem__
        for ids in batches:
            yield pd.Series([b"" if x is None else b"".join(map(at, x.tolist())) for x in ids], dtype=object)

    return decode


def encode_table(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `ids`, which replaces a column of that name."""
    return docs.withColumn("ids", encoder(docs.sparkSession, path, pattern)(F.col(text)))


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def query(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    out = out.withColumn("bytes", decoder(spark, path)(F.col("ids")))
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    with batches_of(spark, 500):  # long texts: memory is bounded by rows of a batch
        return written(out, "bpe")
