"""Removal of repeated 50-byte strings with run-length indexes over repetitive buckets.

1. Every 50-byte window belongs to its anchor, the smallest of its hashes of ``GRAM``
   bytes; equal windows have equal anchors at equal offsets. The anchors' occurrences,
   each with a hash of all bytes its windows touch (its context), are spread by anchor.
   An occurrence whose whole context is also in a smaller doc_id is settled here.
2. What is left repetitive are anchors with several contexts. Their bytes are spread by
   anchor, so that equal windows meet in one bucket, and each bucket gets an index: a
   suffix order, its Burrows-Wheeler transform in runs, and the samples at the run ends.
   Only at the start of a run the match with the neighbour in suffix order is new and is
   compared; streaming through the text, every other position's matching statistic is
   its predecessor's less one. Neighbours that match over 50 bytes or more are one group,
   and the windows of larger doc_ids than the group's smallest are marked.
3. The marked windows meet their document again, and the covered bytes go.

The texts are shuffled once: both meetings use the same exchange. Nothing is broadcast
and nothing is collected. An anchor with more than ``HOT`` contexts is split: each of its
windows becomes a context of its own, spread by the window's own hash, which is exact.

Defined results: a null text counts as empty; a text under 50 bytes loses nothing; equal
windows in rows of one doc_id do not count against each other; a null doc_id counts as
larger than any; repeated rows get equal results, one each; what is kept may cut a
character, as it is bytes; an empty table gives an empty result; other columns are left
out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.kernels import Rolling, anchors, byte_values, mixed, text_blocks
from framewitness.llm.shared import only_text, parts, written

WINDOW, GRAM = 50, 20
#: Contexts of one anchor that stay together.
HOT = 20_000
#: Windows of one text that a task looks at together; longer texts go in pieces.
PIECE = 1 << 22
#: Bytes that one index covers, besides the last anchor's.
INDEX_BYTES = 1 << 21
_LAST = np.iinfo(np.int64).max

#: Anchors and contexts are 48 bits wide; a context counts within its anchor only.
_SPOT = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("id", "<i8"), ("key", "<i4"), ("start", "<i4"), ("more", "u1"), ("flag", "u1")])
_FOUND = ("anchor", "context", "id", "key", "start", "more")
_DEALT = ("anchor", "id", "key", "start", "more", "flag")
_SETTLED, _STILL, _HOT = range(3)
_CUT = np.uint64(16)


def _rows(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and text, so that rows of one doc_id don't mix."""
    docs = only_text(docs)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.hash("text").alias("key"), "text")


def _blocks(batch):
    order = pa.array(np.arange(batch.num_rows))
    for places, buffer, bounds in text_blocks(order, batch.column("text")):
        yield places.to_numpy(), buffer, bounds


def _pieces(buffer, bounds, window):
    """Blocks as they are; a long text in pieces that share window - 1 bytes."""
    n = len(buffer)
    if n <= PIECE or len(bounds) > 2:
        yield 0, buffer, bounds
        return
    for start in range(0, n - window + 1, PIECE):
        piece = buffer[start : start + PIECE + window - 1]
        yield start, piece, np.array([0, len(piece)])


def _pack(rows: np.ndarray, bucket: np.ndarray, names, extra: list[bytes] | None = None):
    """One Arrow row per bucket: the columns one after the other, so that they compress."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    cuts = np.append(heads, len(rows))
    blobs = [b"".join(_column(rows, name, a, b) for name in names) for a, b in zip(cuts, cuts[1:])]
    columns = [pa.array(bucket[heads], pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(blobs, pa.binary())]
    if extra is not None:
        contexts = [extra[i] for i in order.tolist()]
        columns.append(pa.array([b"".join(contexts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "blob", "bytes"][: len(columns)])


def _column(rows, name, a, b) -> bytes:
    values = rows[name][a:b]
    if name in ("anchor", "context"):
        return values.astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()
    return values.tobytes()


def _unpack(blob: bytes, n: int, names) -> np.ndarray:
    rows, at = np.zeros(n, _SPOT), 0
    for name in names:
        if name in ("anchor", "context"):
            low = np.frombuffer(blob, "<u4", n, at).astype(np.uint64)
            rows[name] = low | np.frombuffer(blob, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32)
            at += 6 * n
        else:
            rows[name] = np.frombuffer(blob, _SPOT[name], n, at)
            at += n * _SPOT[name].itemsize
    return rows


def _bucket(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchors >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def _starts_of(rows: np.ndarray, *names: str) -> np.ndarray:
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = False
        for name in names:
            new[1:] |= rows[name][1:] != rows[name][:-1]
    return np.flatnonzero(new)


def _each(values: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(heads, n)))


def spots(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """All anchors' occurrences, packed by bucket."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for at, whole, all_bounds in _blocks(batch):
                for shift, buffer, bounds in _pieces(whole, all_bounds, window):
                    hashes = Rolling(byte_values(buffer))
                    grams = hashes.every(gram)
                    p, a, b = anchors(grams, bounds, window, gram)
                    if not len(p):
                        continue
                    text = np.searchsorted(bounds, a, "right") - 1
                    rows = np.zeros(len(p), _SPOT)
                    rows["anchor"] = grams[p] >> _CUT
                    rows["context"] = mixed(hashes.of(a, b + window) ^ (p - a).astype(np.uint64)) >> _CUT
                    rows["id"], rows["key"] = ids[at[text]], keys[at[text]]
                    rows["start"], rows["more"] = a - bounds[text] + shift, b - a
                    yield _pack(rows, _bucket(rows["anchor"], buckets), _FOUND)

    return docs.mapInArrow(run, "bucket int, n int, blob binary")


def _dealt(rows: np.ndarray, buckets: int):
    """Rows packed by their document."""
    spread = mixed(rows["id"].view(np.uint64) + rows["key"].astype(np.uint64))
    return _pack(rows, (spread % np.uint64(buckets)).astype(np.int32), _DEALT)


def by_document(packed: DataFrame) -> DataFrame:
    """One row per document: settled (start, more) pairs; open anchors, starts, mores, hot."""

    def run(batches):
        found = [
            _unpack(blob, n, _DEALT)
            for batch in batches
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist())
        ]
        if not found:
            return
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows["start"], rows["key"], rows["id"]))]
        cuts = np.append(_starts_of(rows, "id", "key"), len(rows))
        spans, opens = [], []
        for a, b in zip(cuts, cuts[1:]):
            some = rows[a:b]
            done = some[some["flag"] == _SETTLED]
            spans.append(np.stack([done["start"], done["more"]], 1).astype("<i4").tobytes())
            o = some[some["flag"] != _SETTLED]
            opens.append(o["anchor"].tobytes() + o["start"].tobytes() + o["more"].tobytes() + (o["flag"] == _HOT).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["id"][cuts[:-1]]), pa.array(rows["key"][cuts[:-1]]), pa.array(spans, pa.binary()), pa.array(opens, pa.binary())],
            names=["id", "key", "spans", "open"],
        )

    dealt = packed.repartition(parts(packed.sparkSession), "bucket")
    return dealt.mapInArrow(run, "id long, key int, spans binary, open binary")


def settle(packed: DataFrame, hot: int, buckets: int) -> DataFrame:
    """The windows that whole contexts settle, and the occurrences left, by document."""

    def run(batches):
        found = []
        for batch in batches:
            found += [_unpack(blob, n, _FOUND) for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist())]
        if not found:
            return
        rows = np.concatenate(found)
        del found
        rows = rows[np.lexsort((rows["id"], rows["context"], rows["anchor"]))]
        heads = _starts_of(rows, "anchor", "context")
        least = _each(rows["id"][heads], heads, len(rows))
        repeated = rows["id"] > least
        groups = _starts_of(rows[heads], "anchor")  # in terms of contexts
        several = np.diff(np.append(groups, len(heads)))
        first = np.minimum.reduceat(rows["id"][heads], groups)
        last = np.maximum.reduceat(rows["id"][heads], groups)
        by_context = np.repeat(np.where(last > first, several, 0), several)
        contexts = _each(by_context, heads, len(rows))
        still = ~repeated & (contexts > 1)
        rows["flag"] = np.where(still, np.where(contexts > hot, _HOT, _STILL), _SETTLED)
        rows = rows[repeated | still]
        if len(rows):
            yield _dealt(rows, buckets)

    return by_document(packed.mapInArrow(run, "bucket int, n int, blob binary"))


def contexts(joined: DataFrame, window: int, buckets: int) -> DataFrame:
    """The bytes of the occurrences left, packed by bucket of their anchor."""

    def run(batches):
        for batch in batches:
            ids, keys, opened = batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("open").to_pylist()
            for at, buffer, bounds in _blocks(batch):
                data, some, out = buffer.tobytes(), [], []
                for k, i in enumerate(at.tolist()):
                    if blob := opened[i]:
                        n = len(blob) // 14
                        anchor = np.frombuffer(blob, "<u8", n)
                        start = np.frombuffer(blob, "<i4", n, 8 * n)
                        more = np.frombuffer(blob, np.uint8, n, 12 * n).astype(np.int32)
                        hot = np.frombuffer(blob, bool, n, 13 * n)
                        if hot.any():
                            sizes = more[hot] + 1
                            single = np.repeat(start[hot], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                            text = buffer[bounds[k] : bounds[k + 1]]
                            own = Rolling(byte_values(text)).of(single, single + window) >> _CUT
                            anchor = np.concatenate([anchor[~hot], own])
                            start, more = np.concatenate([start[~hot], single]), np.concatenate([more[~hot], np.zeros(len(single), np.int32)])
                        rows = np.zeros(len(anchor), _SPOT)
                        rows["anchor"], rows["id"], rows["key"], rows["start"], rows["more"] = anchor, ids[i], keys[i], start, more
                        some.append(rows)
                        begin = (start.astype(np.int64) + bounds[k]).tolist()
                        out += [data[s : s + m + window] for s, m in zip(begin, more.tolist())]
                if some:
                    rows = np.concatenate(some)
                    yield _pack(rows, _bucket(rows["anchor"], buckets), _OPEN, out)

    return joined.mapInArrow(run, "bucket int, n int, blob binary, bytes binary")


_OPEN = ("anchor", "id", "key", "start", "more")


def _first_ranks(text: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Ranks of the suffixes by their first values, how many those are, and whether a
    separator is among them. Separators are the values below all that come twice, if each
    is larger than those before it; else there are none, and a rank is of one value."""
    n, low = len(text), int(text.min(initial=0))
    many = np.bincount(text - low)
    twice = np.flatnonzero(many > 1)
    first = twice[0] if len(twice) else len(many)
    apart = text - low < first
    if not len(twice) or (np.diff(text[apart]) < 0).any() or not apart[-1]:
        return np.unique(text, return_inverse=True)[1].astype(np.int64), 1, np.zeros(n, bool)
    codes = np.cumsum(many[first:] > 0)
    symbols = np.where(apart, 0, codes[np.maximum(text - low - first, 0)])
    bits = int(codes[-1]).bit_length()
    span = min(n, 63 // bits)
    rank, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(span):
        rank <<= bits
        # What is after a separator does not count. The last value is one.
        rank[: n - k] |= np.where(ended[: n - k], 0, symbols[k:])
        ended[: n - k] |= apart[k:]
    return rank, span, ended


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose values at separators are all different.

    By doubling the length that is sorted; only what is still tied is sorted again. It
    begins with as many values as a whole number holds.
    """
    n = len(text)
    rank, span, ended = _first_ranks(text)
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.ones(n, np.int64)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        # Suffixes alike up to a separator are in the order of their separators.
        new |= ended[order]
        places = np.flatnonzero(new)
        # The rank of a suffix is the first place of its tie.
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(places, np.diff(np.append(places, n)))
        if len(places) == n:
            return order
        sizes = np.diff(np.append(places, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        some = order[tied]
        after = some + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = rank[some] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[tied] = some[by]
        # Both halves of the pair are the new rank.
        full = rank * (n + 1)
        full[some] = key
        rank = full
        span *= 2


def run_length_index(text: np.ndarray, order: np.ndarray):
    """The runs of the Burrows-Wheeler transform: values, first rows, and the suffixes
    sampled at both ends of each run."""
    bwt = text[order - 1]
    first = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
    last = np.append(first[1:], len(bwt)) - 1
    return bwt[first], first, order[first], order[last]


def matching_statistics(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position how far it matches the suffix before it in suffix order.

    At a run's first row the match is compared anew, with the sample at the end of the
    run before; in between it is the one of the position before less one.
    """
    n = len(text)
    _, first, begin, end = run_length_index(text, order)
    here, there = begin[1:], end[:-1]
    match = np.zeros(len(here), np.int64)
    going = np.arange(len(here))
    # To the end of the match, however long, as the values that follow are smaller by one
    # each: some values at once as long as all of them are alike, then one by one.
    rank, span, ended = _first_ranks(text)
    less = np.zeros(len(here), bool)
    while len(going):
        x, y = here[going] + match[going], there[going] + match[going]
        same = (x < n) & (y < n)
        same[same] = (rank[x[same]] == rank[y[same]]) & ~ended[x[same]] & ~ended[y[same]]
        less[going[~same]] = True
        going = going[same]
        match[going] += span
    going = np.flatnonzero(less)
    for _ in range(span - 1):
        x, y = here[going] + match[going], there[going] + match[going]
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        going = going[same]
        match[going] += 1
    known = np.full(n, -1, np.int64)
    known[here] = match
    known[begin[0]] = 0
    known[0] = known[0] if known[0] >= 0 else 0
    source = np.maximum.accumulate(np.where(known >= 0, np.arange(n), 0))
    return np.maximum(known[source] - (np.arange(n) - source), 0)


def marked(contexts: list[bytes], ids: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context the offsets of the windows that a context of a smaller id has too."""
    lengths = np.array([len(c) for c in contexts])
    total = lengths.sum() + len(contexts)
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(total, np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    inside = np.ones(total, bool)
    inside[ends] = False
    text[inside] = data.astype(np.int64) + len(contexts)
    text[ends] = np.arange(len(contexts))  # separators differ, so no match crosses one
    order = suffix_order(text)
    match = matching_statistics(text, order)
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    group = np.cumsum(match[order] < window)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = _each(np.minimum.reduceat(ids[owner[order]], heads), heads, total)
    hit = np.zeros(total, bool)
    hit[order] = ids[owner[order]] > least
    begins = ends - lengths
    left = np.repeat(ends, lengths + 1) - np.arange(total)
    hit &= left >= window
    where = np.flatnonzero(hit)
    cuts = np.searchsorted(where, np.append(begins, total))
    return [where[a:b] - s for a, b, s in zip(cuts, cuts[1:], begins)]


def index_buckets(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """Per document: the windows marked by the buckets' indexes."""

    def run(batches):
        found, data = [], []
        for batch in batches:
            for n, blob, own in zip(*(batch.column(c).to_pylist() for c in ("n", "blob", "bytes"))):
                rows = _unpack(blob, n, _OPEN)
                found.append(rows)
                cuts = np.append(0, np.cumsum(rows["more"].astype(np.int64) + window)).tolist()
                data += [own[a:b] for a, b in zip(cuts, cuts[1:])]
        if not found:
            return
        rows = np.concatenate(found)
        order = np.lexsort((rows["id"], rows["anchor"]))
        rows, data = rows[order], [data[i] for i in order.tolist()]
        heads = np.append(_starts_of(rows, "anchor"), len(rows)).tolist()
        out, begin, size = [], 0, 0
        for a, b in zip(heads, heads[1:]):
            size += int(rows["more"][a:b].sum(dtype=np.int64)) + window * (b - a)
            if size >= INDEX_BYTES or b == len(rows):
                out.append(_marked_rows(rows[begin:b], data[begin:b], window))
                begin, size = b, 0
        out = np.concatenate(out)
        if len(out):
            yield _dealt(out, buckets)

    return by_document(packed.mapInArrow(run, "bucket int, n int, blob binary")).drop("open")


def _marked_rows(rows: np.ndarray, data: list[bytes], window: int) -> np.ndarray:
    """Rows of settled windows, one for each run of marked starts in a context."""
    distinct = list(dict.fromkeys(data))
    number = {c: i for i, c in enumerate(distinct)}
    which = np.array([number[c] for c in data])
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, which, rows["id"])
    out = []
    marks = marked(distinct, least, window)
    # A context that is in several rows of different ids: the larger ones are settled whole.
    for i, c in enumerate(which.tolist()):
        offsets = marks[c] if rows["id"][i] == least[c] else np.arange(int(rows["more"][i]) + 1)
        if len(offsets):
            breaks = np.flatnonzero(np.diff(offsets) > 1)
            begins, ends = offsets[np.append(0, breaks + 1)], offsets[np.append(breaks, len(offsets) - 1)]
            some = np.zeros(len(begins), _SPOT)
            some["id"], some["key"] = rows["id"][i], rows["key"][i]
            some["start"], some["more"] = rows["start"][i] + begins, ends - begins
            out.append(some)
    return np.concatenate(out) if out else rows[:0]


def deduped(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    spark = docs.sparkSession
    docs, n = _rows(docs), parts(spark)
    buckets = 8 * n
    packed = spots(docs, window, gram, buckets).repartition(n, "bucket")
    settled = written(settle(packed, hot, 2 * n), "settled")
    # One exchange of the texts serves both joins.
    placed = docs.repartition(n, "id", "key")
    left = settled.where(F.length("open") > 0).select("id", "key", "open")
    joined = placed.join(left.hint("shuffle_hash"), ["id", "key"]).select("doc_id", "id", "key", "text", "open")
    indexed = index_buckets(contexts(joined, window, buckets).repartition(n, "bucket"), window, 2 * n)
    spans = settled.select("id", "key", "spans").where(F.length("spans") > 0).unionByName(indexed)
    spans = spans.groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            yield from _without_spans(batch, window)

    rows = placed.join(spans.hint("shuffle_hash"), ["id", "key"], "left").select("doc_id", "id", "key", "text", "spans")
    return rows.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _without_spans(batch, window: int):
    spans = batch.column("spans").to_pylist()
    for at, buffer, bounds in _blocks(batch):
        edge = np.zeros(len(buffer) + 1, np.int32)
        for k, i in enumerate(at.tolist()):
            if spans[i]:
                pairs = np.frombuffer(b"".join(spans[i]), "<i4").reshape(-1, 2).astype(np.int64) + [bounds[k], 0]
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sums = np.append(0, np.cumsum(gone))[bounds]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        cuts = bounds[1:-1]
        cuts = cuts[cuts < len(buffer)]
        begins[cuts] = gone[cuts]
        runs = np.append(0, np.cumsum(begins))[bounds]
        data, cut = buffer[~gone].tobytes(), bounds - sums
        kept = [data[a:b] for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").slice(int(at[0]), len(at)),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(np.diff(sums), pa.int64()),
                pa.array(np.diff(runs), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: the digest columns of the contract."""
    return deduped(docs).drop("kept")
