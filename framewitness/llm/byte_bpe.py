"""Byte-level BPE with the tokenizers library over Arrow batches.

Byte-level BPE works on characters that stand for bytes. Encoding maps bytes to those
characters and back gives offsets in characters of the text; decoding reverses the byte
table id by id, so a character that is split over several ids comes back whole.

Whole texts, any length; a few hundred texts or a megabyte are encoded at a time, so a
task's memory follows the longest text. Rows never leave their partition: no shuffle.

Defined results: a null text counts as empty and has no ids, repeated rows are encoded
alike, an empty table gives an empty result, other columns are left out by ``digests``
and kept by ``stage`` (the last, whose own columns replace equal names).
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from weakref import WeakSet

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewitness.llm.shared import only_text, released

RANKS = "byte_bpe_50k.tiktoken"
_TEXTS, _BYTES = 256, 1 << 20
#: Different matches whose ids a task keeps; beyond it the table starts anew.
_KEPT = 500_000
_LOADED: WeakSet[Vocabulary] = WeakSet()


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the
    others for code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A rank file as a tokenizer of the library, and the bytes of each id."""

    def __init__(self, ranks: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        # The tasks are parallel already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(public_tokenizers.path(ranks), "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        shown = byte_characters()
        said = {token: "".join(shown[b] for b in token) for token in rank}
        pairs = (_parts(token, rank) for token in sorted(rank, key=rank.get))
        merges = [(said[a], said[b]) for a, b in pairs if b]
        vocabulary = {said[token]: i for token, i in rank.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, cache_capacity=0))
        # The texts come as matches of the pattern; this maps their bytes to characters.
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        table = [b""] * (max(rank.values()) + 1)
        for i, token in sorted((i, token) for token, i in rank.items()):
            # Reversing the byte table on the library's own token.
            chars = self.tokenizer.id_to_token(i)
            table[i] = bytes(map(_reversed().__getitem__, chars))
            assert table[i] == token
        self.lengths = np.array(list(map(len, table)))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.kept: dict[str, bytes] = {}
        _LOADED.add(self)

    def forget(self) -> None:
        self.kept = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.kept) > _KEPT:
            self.forget()
        new = list(set().union(*split).difference(self.kept))
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            for match, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.kept[match] = np.asarray(got.ids, "<u4").tobytes()
        return [b"".join(map(self.kept.__getitem__, matches)) for matches in split]


@lru_cache(1)
def _reversed() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


@lru_cache(2)
def load(ranks: str = RANKS) -> Vocabulary:
    return Vocabulary(ranks)


def _forget() -> None:
    """Drop the ids that a task has kept; the vocabularies stay."""
    for vocabulary in _LOADED:
        vocabulary.forget()


def _parts(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: what remains of its bytes when only
    merges of a lower rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        ranked = [(rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        least, i = min(ranked)
        if least >= rank[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else (token, b"")


def groups(texts: list[str]):
    """Runs of texts that are encoded together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _BYTES or i - start >= _TEXTS:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode(texts: list[str], ranks: str = RANKS):
    """Ids of each text, one array at a time."""
    for some in groups(texts):
        for got in load(ranks).ids(some):
            yield np.frombuffer(got, "<u4")


def encode_with_offsets(texts: list[str], ranks: str = RANKS):
    """Ids of each text and the characters [start, end) each id touches; ids that
    share a split character touch the same one."""
    vocabulary = load(ranks)
    for text in texts:
        ids, offsets = [], []
        for match in vocabulary.pattern.finditer(text):
            got = vocabulary.tokenizer.encode(match.group(), add_special_tokens=False)
            ids += got.ids
            offsets += [(match.start() + a, match.start() + b) for a, b in got.offsets]
        yield np.asarray(ids, "<u4"), offsets


def decode(ids, ranks: str = RANKS) -> bytes:
    """The bytes of the ids; any cut of a character's bytes over ids is fine."""
    vocabulary, ids = load(ranks), np.asarray(ids, np.int64)
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    shift = np.repeat(vocabulary.starts[ids] - (ends - lengths), lengths)
    return vocabulary.bytes[shift + np.arange(len(shift))].tobytes()


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per document: the digest columns of the contract."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            counts, ids, decoded = [], [], []
            for got in encode(texts, ranks):
                counts.append(len(got))
                ids.append(hashlib.sha256(got.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode(got, ranks)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return only_text(docs).mapInArrow(released(run, _forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, ranks: str = RANKS, offsets: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, starts and ends in characters of the text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            found = [(i, o) for i, o in encode_with_offsets(texts, ranks)] if offsets else [(i, []) for i in encode(texts, ranks)]
            out = [batch.column("doc_id"), pa.array([i.tolist() for i, _ in found], pa.list_(pa.int64()))]
            if offsets:
                out += [pa.array([[x[k] for x in o] for _, o in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "starts", "ends"][: len(out)])

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return only_text(docs).mapInArrow(released(run, _forget), "doc_id long, ids array<long>" + more)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the digests of each document."""
    return digests(docs)
