"""Substring dedup of 50-word windows behind a count-min sketch.

1. Every window is represented by its anchor: the smallest of its hashes of ``GRAM``
   words. Equal windows have equal anchors, so an anchor is seen at least as often as any
   of its windows. Each partition counts its anchors in a count-min sketch; the sketches
   are shuffled in blocks of cells and added. The merged counts overestimate.
2. A second pass over the texts takes only the windows whose anchor is estimated to be
   there twice, groups them exactly by a 96-bit hash of all 50 words, and marks those
   that also start in a document with a smaller doc_id.
3. The marked starts are gathered by document, one row for each, meet their document
   again, and the covered words go.

No window is lost: an estimate below two proves that a window is alone. The sketch has a
fixed size, at most ``2 * MOST_CELLS`` cells, and as bits at most 2 * MOST_CELLS / 8
bytes, which is the proven bound of what the driver collects and broadcasts. On tables
for which that is too small, more windows reach the second pass and the result is the
same. Windows are spread by their hash; equal ones of a block of texts count as one
there, so that a passage in a third of all rows is no heavy group.

Defined results: a null text has no words; fewer than 50 words lose none; equal windows
in rows of one doc_id do not count against each other; a null doc_id counts as larger
than any; repeated rows get equal results, one each; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.kernels import Rolling, anchors, mixed, text_blocks, word_hashes, word_spans
from framewitness.llm.shared import only_text, parts

WINDOW, GRAM = 50, 20
#: Cells of one of the sketch's two rows, at least and at most.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
#: Bytes of text for each cell; a text has an anchor for about every 100 bytes.
_BYTES_A_CELL = 64
_BLOCK = 1 << 16
_LAST = np.iinfo(np.int64).max


def _texts(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and text, so that rows of one doc_id don't mix."""
    return only_text(docs).withColumn("key", F.xxhash64("text"))


def _blocks(batch):
    """Word spans and ids of a batch, a block at a time; a null doc_id is the largest."""
    order = pa.array(np.arange(batch.num_rows))
    ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
    for places, buffer, bounds in text_blocks(order, batch.column("text")):
        at = places.to_numpy()
        starts, ends, words = word_spans(buffer, bounds)
        yield at, ids[at], buffer, bounds, starts, ends, words


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64(cells - 1)
    return [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)]


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Whether each cell of the merged sketch counts two or more, as packed bits of two rows."""

    def count(batches):
        counts = np.zeros((2, cells), np.uint8)
        for batch in batches:
            for _, _, buffer, _, starts, ends, words in _blocks(batch):
                grams = Rolling(word_hashes(buffer, starts, ends)).every(gram)
                p, _, _ = anchors(grams, words, window, gram)
                for row, cell in enumerate(_cells(grams[p], cells)):
                    at, n = np.unique(cell, return_counts=True)
                    counts[row, at] = np.minimum(counts[row, at].astype(np.int64) + n, 255)
        size = min(_BLOCK, cells)
        for row in range(2):
            for block in range(cells // size):
                some = counts[row, block * size : (block + 1) * size]
                at = np.flatnonzero(some)
                if len(at):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([row * (cells // size) + block], pa.int32()),
                            "cells": pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                            "counts": pa.array([some[at].tobytes()], pa.binary()),
                        }
                    )

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts"))):
                have = merged.setdefault(block, np.zeros(min(_BLOCK, cells), np.uint8))
                at = np.frombuffer(at, np.uint16)
                have[at] = np.minimum(have[at].astype(np.int64) + np.frombuffer(n, np.uint8), 255)
        if merged:
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array(list(merged), pa.int32()),
                    "bits": pa.array([np.packbits(x >= 2).tobytes() for x in merged.values()], pa.binary()),
                }
            )

    spark = docs.sparkSession
    counted = _texts(docs).select("doc_id", "text").mapInArrow(count, "block int, cells binary, counts binary")
    merged = counted.repartition(parts(spark), "block").mapInArrow(merge, "block int, bits binary")
    size = min(_BLOCK, cells)
    bits = np.zeros((2 * cells // size, size // 8), np.uint8)
    # A fixed number of blocks, of at most 2 * MOST_CELLS / 8 bytes together.
    for row in merged.collect():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(2, -1)


def _estimated_twice(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for row, cell in enumerate(_cells(hashes, cells)):
        out &= (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def stretches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [a, b], one after the other."""
    sizes = b - a + 1
    return np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_ROW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("id", "<i8"), ("key", "<i8"), ("start", "<i4")])


def _packed(rows: np.ndarray, bucket: np.ndarray, settled: bool):
    """One Arrow row per bucket, column by column so that it compresses."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    cuts = np.append(heads, len(rows))
    names = ("id", "key", "start") if settled else _ROW.names
    blobs = [b"".join(rows[name][a:b].tobytes() for name in names) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[heads], pa.int32()),
            pa.array(np.full(len(heads), settled)),
            pa.array(np.diff(cuts), pa.int32()),
            pa.array(blobs, pa.binary()),
        ],
        names=["bucket", "settled", "n", "blob"],
    )


def _unpacked(blob: bytes, n: int, settled: bool) -> np.ndarray:
    rows, at = np.zeros(n, _ROW), 0
    for name in ("id", "key", "start") if settled else _ROW.names:
        kind = _ROW[name]
        rows[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return rows


def _repeated_in_block(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by window, and whether a smaller doc_id has the window too."""
    rows = rows[np.lexsort((rows["id"], rows["h2"], rows["h1"]))]
    if not len(rows):
        return rows, np.zeros(0, bool)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    heads = np.flatnonzero(new)
    least = np.repeat(rows["id"][heads], np.diff(np.append(heads, len(rows))))
    return rows, rows["id"] > least


def repeated_starts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int | None = None) -> DataFrame:
    """id, key and the starts (packed 32-bit integers) of the windows that also start in
    a document with a smaller doc_id."""
    spark = docs.sparkSession
    docs = _texts(docs)
    if cells is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (int(size) // _BYTES_A_CELL).bit_length()))
    sent = spark.sparkContext.broadcast(sketch(docs, cells, window, gram))
    # Few places for the results, as each task sends a row to each.
    buckets, places = 8 * parts(spark), 2 * parts(spark)

    def candidates(batches):
        bits = sent.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for at, ids, buffer, _, starts, ends, words in _blocks(batch):
                first = Rolling(word_hashes(buffer, starts, ends))
                grams = first.every(gram)
                p, a, b = anchors(grams, words, window, gram)
                twice = _estimated_twice(bits, grams[p], cells)
                begin = stretches(a[twice], b[twice])
                if not len(begin):
                    continue
                second = Rolling(word_hashes(buffer, starts, ends, 1), 1)
                text = np.searchsorted(words, begin, "right") - 1
                rows = np.zeros(len(begin), _ROW)
                rows["h1"] = first.of(begin, begin + window)
                rows["h2"] = second.of(begin, begin + window) >> np.uint64(32)
                rows["id"], rows["key"], rows["start"] = ids[text], keys[at[text]], begin - words[text]
                rows, settled = _repeated_in_block(rows)
                for done in (False, True):
                    some = rows[settled == done]
                    spread = some["h1"]
                    if done:  # these are known to be repeated; any bucket will do
                        spread = mixed(spread + some["start"].astype(np.uint64))
                    if len(some):
                        yield _packed(some, ((spread >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), done)

    def settle(batches):
        open_rows, done = [], []
        for batch in batches:
            for settled, n, blob in zip(*(batch.column(c).to_pylist() for c in ("settled", "n", "blob"))):
                (done if settled else open_rows).append(_unpacked(blob, n, settled))
        if open_rows:
            rows, repeated = _repeated_in_block(np.concatenate(open_rows))
            done.append(rows[repeated])
        if done:
            rows = np.concatenate(done)
            rows = rows[np.lexsort((rows["start"], rows["key"], rows["id"]))]
            if len(rows):
                spread = mixed(rows["key"].view(np.uint64) ^ rows["id"].view(np.uint64))
                yield _packed(rows, (spread % np.uint64(places)).astype(np.int32), True)

    def gather(batches):
        found = [
            _unpacked(blob, n, True)
            for batch in batches
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist())
        ]
        if found:
            yield from _by_row(np.concatenate(found))

    schema = "bucket int, settled boolean, n int, blob binary"
    packed = docs.mapInArrow(candidates, schema).repartition(parts(spark), "bucket")
    by_document = packed.mapInArrow(settle, schema).repartition(parts(spark), "bucket")
    return by_document.mapInArrow(gather, "id long, key long, starts binary")


def _by_row(rows: np.ndarray):
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["start"], rows["key"], rows["id"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["id"][1:] != rows["id"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
    cuts = np.append(np.flatnonzero(new), len(rows))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows["id"][cuts[:-1]]),
            pa.array(rows["key"][cuts[:-1]]),
            pa.array([rows["start"][a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        ],
        names=["id", "key", "starts"],
    )


def covered(length: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``length`` items the windows at the starts cover."""
    edge = np.zeros(length + window + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:length] > 0


def with_starts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with the starts found for it, or null."""
    docs = _texts(docs).withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))
    return docs.join(found.hint("shuffle_hash"), ["id", "key"], "left").select("doc_id", "text", "starts")


def kept_text(buffer, bounds, starts, ends, words, kept):
    """The kept words of each text joined by one space: bytes and offsets."""
    edge = np.zeros(len(buffer) + 1, np.int32)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    stays = np.cumsum(edge[:-1]) > 0
    which = np.flatnonzero(kept)
    text = np.searchsorted(words, which, "right") - 1
    followed = np.zeros(len(which), bool)
    followed[:-1] = text[1:] == text[:-1]
    gaps = ends[which[followed]]
    out = buffer.copy()
    out[gaps] = 0x20
    stays[gaps] = True
    sums = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(stays, out=sums[1:])
    return out[stays], sums[bounds]


def deduped(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row."""

    def run(batches):
        for batch in batches:
            found = batch.column("starts").to_pylist()
            for at, _, buffer, bounds, starts, ends, words in _blocks(batch):
                kept = np.ones(len(starts), bool)
                for k, i in enumerate(at.tolist()):
                    if found[i]:
                        gone = np.frombuffer(found[i], "<i4")
                        kept[words[k] : words[k + 1]] = ~covered(words[k + 1] - words[k], gone, window)
                out, cuts = kept_text(buffer, bounds, starts, ends, words, kept)
                data = out.tobytes()
                texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
                sums = np.append(0, np.cumsum(kept))[words]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(int(at[0]), len(at)),
                        pa.array(np.diff(words), pa.int64()),
                        pa.array(np.diff(words) - np.diff(sums), pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    rows = with_starts(docs, repeated_starts(docs, window, gram, cells))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: the digest columns of the contract."""
    return deduped(docs).drop("kept_text")
