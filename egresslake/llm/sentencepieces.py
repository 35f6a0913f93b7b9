r"""Operator 7: SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed here (wire format, no generated classes): pieces with scores and types,
trainer settings (unigram or BPE, byte fallback) and normaliser settings (dummy prefix, extra spaces,
escaping). From them a tokenizers pipeline is rebuilt: the normaliser with the U+2581 marker, unigram
scores, or BPE merges ranked by piece score, byte fallback, and the decoder. Batches are encoded
by the library's threads, without a pre-tokenizer, as SentencePiece has none.

Decoding joins the spellings of ids, bytes included; it equals the tokenizers decoder (tests compare them) and takes a seventh of its time.

Parity: the operator compares ids and decoded text with the sentencepiece library's for whole texts of every
document whose parity fold is hit (parity_every; 1, for all, unless told otherwise) and reports it per row.

Defined results: a null text encodes like an empty one, to no ids; unknown characters become bytes;
control pieces' names in a text are ordinary text; lone surrogates, which Spark strings cannot hold, do not occur;
rows that repeat get equal results; an empty table gives an empty result; further columns are ignored
unless named.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
#: One document in so many is encoded by both libraries.
PARITY_EVERY = 1
#: Characters encoded at a time, so that token objects stay small in memory.
BATCH_CHARS = 400_000
# Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, data[i : i + n]
            i += n


class Model:
    """A parsed SentencePiece model."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.extra_spaces_go = bool(rules.get(4, 1))
        self.escapes = bool(rules.get(5, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """BPE merges: every split of a piece into two pieces, in order of the piece's score."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in ids and b in ids:
                    found.append((-self.pieces[i][1], i, ids[a], a, b))
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            t = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback))
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            unk = self.pieces[self.unknown][0]
            t = Tokenizer(models.BPE(vocab, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.extra_spaces_go:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escapes else " "))
        if self.escapes:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            back.append(decoders.Strip(" ", 1, 0))
        t.decoder = decoders.Sequence(back)
        return t

    def spellings(self) -> list[bytes]:
        """The bytes that each id stands for in decoded text; control pieces keep their names."""
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    def decoded(self, ids: list[int], spelled: list[bytes]) -> str:
        """Text of ids: joined spellings, bytes that are no UTF-8 as U+FFFD, without the dummy prefix."""
        out = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


_loaded: dict[str, object] = {}


def loaded(data: bytes):
    """The tokenizer for a model file's bytes, built once in a Python worker."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _loaded:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _loaded[name] = Model(data).tokenizer()
    return _loaded[name]


def speller(data: bytes):
    """A function from ids to text, built once in a Python worker."""
    name = "text" + hashlib.sha256(data).hexdigest()
    if name not in _loaded:
        model = Model(data)
        spelled = model.spellings()
        _loaded[name] = lambda ids: model.decoded(ids, spelled)
    return _loaded[name]


def original(data: bytes):
    """The sentencepiece library's processor, for parity."""
    name = "sp" + hashlib.sha256(data).hexdigest()
    if name not in _loaded:
        import sentencepiece

        _loaded[name] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _loaded[name]


def encode_all(t, texts: list[str]) -> Iterator[list[int]]:
    """Ids of texts in order, encoded in batches of about BATCH_CHARS characters."""
    batch, chars = [], 0
    for text in [*texts, None]:
        if text is None or (batch and chars + len(text) > BATCH_CHARS):
            for e in t.encode_batch_fast(batch, add_special_tokens=False) if batch else []:
                yield e.ids
            batch, chars = [], 0
        if text is not None:
            batch.append(text)
            chars += len(text)


def encode(docs: DataFrame, data: bytes, id_col: str = "doc_id", text_col: str = "text", parity_every: int = PARITY_EVERY, also: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, the columns named in also, token_ids, n_tokens, ids_sha256, round_trip, parity.

    ids_sha256: lowercase hex, of the ids as little-endian 32-bit numbers.

    round_trip: decoding the ids gives the text (false for texts that hold the marker itself, which
    the model cannot tell from a space). parity: the sentencepiece library gives the same ids and
    decodes them to the same text; null where not asked.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        t, sp, text_of = loaded(model), original(model), speller(model)
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"]]
            ids, digests, same, equal = [], [], [], []
            for text, check, found in zip(texts, pdf["check"], encode_all(t, texts), strict=True):
                ids.append(np.array(found, dtype="<i4"))
                digests.append(hashlib.sha256(ids[-1].tobytes()).hexdigest())
                back = text_of(found)
                same.append(back == text)
                equal.append(sp.encode(text, num_threads=1) == found and sp.decode(found) == back if check else None)
            yield pd.DataFrame({**{c: pdf[c] for c in kept}, "token_ids": ids, "n_tokens": [len(x) for x in ids], "ids_sha256": digests, "round_trip": same, "parity": pd.array(equal, dtype="boolean")})

    kept = {f"k{i}": c for i, c in enumerate([id_col, *(also or [])])}
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in kept.items())
    check = F.pmod(F.xxhash64(F.col(id_col)), F.lit(parity_every)) == 0
    rows = docs.select(*[F.col(c).alias(k) for k, c in kept.items()], F.col(text_col).alias("text"), check.alias("check"))
    out = rows.mapInPandas(run, f"{kinds}, token_ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")
    return out.withColumnsRenamed(kept)


def decode(tokens: DataFrame, data: bytes, ids_col: str = "token_ids") -> DataFrame:
    """tokens with a column decoded: the text of the ids; null ids decode to null."""
    shared = tokens.sparkSession.sparkContext.broadcast(data)

    @F.pandas_udf("string")
    def back(col: pd.Series) -> pd.Series:
        text_of = speller(shared.value)
        return pd.Series([None if x is None else text_of(x) for x in col], dtype=object)

    return tokens.withColumn("decoded", back(F.col(ids_col)))


def read_model(path: str | None = None) -> bytes:
    with open(path or model_path(), "rb") as f:
        return f.read()


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Query: tokens of every document, as a count and a digest of the ids."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_model(path))
    return out.select("doc_id", "n_tokens", "ids_sha256", "round_trip", "parity")
