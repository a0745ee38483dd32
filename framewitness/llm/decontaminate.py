"""Benchmark decontamination by spaced seeds.

A seed looks at ``SPAN`` words through a fixed mask that ignores some of them, so that a
changed word under an ignored place does not hide a copied passage. Items and documents
are hashed under every mask at every word, the hashes are joined, and around each hit the
document is laid against the item word by word: the best stretch, in which a match counts
one and another word takes off ``PENALTY``, must hold ``NEEDED`` matching words (or three
quarters of a shorter item's) with at most one changed word in four.

Items of fewer than ``SPAN`` words, but five at least, are sought whole and unchanged.

With ``whole``, as the query and the stage use it, three quarters of an item's words at
their places are enough too, wherever the others are, also for items of five words and
more, and the seeds are ``CLOSE_MASKS``, which miss no such copy and no such stretch.
Items under five words say nothing about copying and are not sought.

The documents' hashes are first held against two filters of fixed size (``FILTER`` bits
each, set where the low and the high half of an item's hash fall; the driver gets no more
than these bits), so that only words around possible hits leave a task. All else is equi-joins without hints: the items
may be many. A hot hash of an item is met by rows that are one per passage.

Defined results: a null or empty text or item has no words; words are runs of other
characters than ``[\\x20\\x09-\\x0D]``, A-Z in lower case, without ASCII marks at their
ends; a document meets each item once, with its best stretch; repeated rows and items
give one row per pair of ids; rows with null ids are compared alike and keep their null
id; empty tables give an empty result; other columns are left out by ``leaks`` and kept
by ``stage``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.kernels import lower_ascii, mixed, text_blocks, trimmed, word_hashes, word_spans
from framewitness.llm.shared import bit_filter, released, table, unpacked, written

SPAN = 12
# The places that each mask looks at, eight of twelve, both ends included.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6, 7),
    (0, 1, 3, 4, 6, 8, 10, 11),
    (0, 2, 3, 5, 7, 8, 9, 11),
    (0, 1, 2, 5, 6, 9, 10, 11),
)
# Of four words each. However a quarter of 5, 8, 12, 16 or 20 words is changed, one of them
# sees no change; as all longer passages hold such a stretch with no more than a quarter
# changed, that holds for every length from five on.
CLOSE_MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4), (0, 1, 2, 5))
SHORTEST = 5
NEEDED, PENALTY = 13, 3
FILTER = 1 << 24
#: Words kept on both sides of a hit besides the item's own length.
_SIDE = 16


def _words(batch, name):
    """Per block: places, word hashes and word offsets of the texts."""
    order = pa.array(np.arange(batch.num_rows))
    for places, buffer, bounds in text_blocks(order, batch.column(name)):
        buffer = lower_ascii(buffer)
        starts, ends, words = word_spans(buffer, bounds)
        if len(starts):
            starts, ends = trimmed(buffer, starts, ends)
            yield places.to_numpy(), word_hashes(buffer, starts, ends), words
        else:
            yield places.to_numpy(), np.zeros(0, np.uint64), words


def seeds(values: np.ndarray, bounds: np.ndarray, shorter=(), masks=MASKS):
    """(word, hash) of every seed of the texts: all masks at all words, and whole
    stretches of the lengths in ``shorter``."""
    n = len(values)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    for k, mask in enumerate(masks):
        reach = max(mask) + 1
        at = np.flatnonzero(left >= reach)
        yield at, _seed(values, at, mask, k)
    for length in shorter:
        at = np.flatnonzero(left >= length)
        yield at, _seed(values, at, range(length), 100 + length)


def _seed(values, at, mask, salt):
    out = np.full(len(at), salt, np.uint64)
    for place in mask:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[at + place])
    return out


def item_seeds(items: DataFrame, whole: bool = False) -> DataFrame:
    """seed, item_id, place and n_words: an item of SPAN words or more by the masks, a
    shorter one whole; with ``whole`` both by CLOSE_MASKS."""
    masks, least = (CLOSE_MASKS, SHORTEST) if whole else (MASKS, SPAN)

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for at, values, words in _words(batch, "text"):
                counts = np.diff(words)
                owner = np.repeat(np.arange(len(counts)), counts)
                lengths = sorted({int(c) for c in counts if SHORTEST <= c < least})
                for k, (place, seed) in enumerate(seeds(values, words, lengths, masks)):
                    item = owner[place]
                    if k < len(masks):
                        fits = counts[item] >= least
                    else:
                        fits = counts[item] == lengths[k - len(masks)]
                    place, seed, item = place[fits], seed[fits], item[fits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(seed.view(np.int64)),
                            ids.take(pa.array(at[item])),
                            pa.array((place - words[item]).astype(np.int32)),
                            pa.array(counts[item].astype(np.int32)),
                        ],
                        names=["seed", "item_id", "place", "n_words"],
                    )

    return items.mapInArrow(released(run), "seed long, item_id long, place int, n_words int")


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for at, values, words in _words(batch, "text"):
                data = [values[a:b].tobytes() for a, b in zip(words, words[1:])]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(data, pa.binary())], names=["item_id", "item"])

    return items.mapInArrow(released(run), "item_id long, item binary")


def passages(docs: DataFrame, filters: tuple[bytes, bytes], shorter: list[int], side: int, masks=MASKS) -> DataFrame:
    """Stretches of documents around possible hits: doc_id, the words of the stretch (and
    how many there are before it), and its hits."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)

    mask = np.uint64(FILTER - 1)

    def run(batches):
        low_bits, high_bits = map(unpacked, sent.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, values, words in _words(batch, "text"):
                spots, hashes = [], []
                for place, seed in seeds(values, words, shorter, masks):
                    hit = np.flatnonzero(low_bits[(seed & mask).astype(np.int64)])
                    hit = hit[high_bits[(seed[hit] >> np.uint64(32) & mask).astype(np.int64)]]
                    spots.append(place[hit])
                    hashes.append(seed[hit])
                spots, hashes = np.concatenate(spots), np.concatenate(hashes)
                if not len(spots):
                    continue
                order = np.argsort(spots, kind="stable")
                spots, hashes = spots[order], hashes[order]
                text = np.searchsorted(words, spots, "right") - 1
                new = np.ones(len(spots), bool)
                new[1:] = (text[1:] != text[:-1]) | (spots[1:] - spots[:-1] > 2 * side)
                cuts = np.append(np.flatnonzero(new), len(spots))
                rows = []
                for a, b in zip(cuts, cuts[1:]):
                    k = text[a]
                    low = max(words[k], spots[a] - side)
                    high = min(words[k + 1], spots[b - 1] + SPAN + side)
                    rows.append((int(at[k]), int(low - words[k]), values[low:high].tobytes(), hashes[a:b].view(np.int64).tolist(), (spots[a:b] - low).astype(np.int32).tolist()))
                which, before, data, seed, spot = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(which)),
                        pa.array(before, pa.int32()),
                        pa.array(data, pa.binary()),
                        pa.array(seed, pa.list_(pa.int64())),
                        pa.array(spot, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "before", "words", "seeds", "spots"],
                )

    schema = "doc_id long, before int, words binary, seeds array<long>, spots array<int>"
    return docs.mapInArrow(released(run), schema)


def best_stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Lays the item's word 0 on ``words[shift]``: matching words of the best stretch, its
    first word and its length."""
    low, high = max(0, shift), min(len(words), shift + len(item))
    if high <= low:
        return 0, low, 0
    same = words[low:high] == item[low - shift : high - shift]
    sums = np.append(0, np.cumsum(np.where(same, 1, -PENALTY)))
    lowest = np.minimum.accumulate(sums)
    best = (sums - lowest).max()
    out = (0, low, 0)
    for end in np.flatnonzero(sums - lowest == best).tolist():  # of equal ones the longest
        begin = int(np.argmax(sums == lowest[end]))
        if end > begin:
            out = max(out, (int(same[begin:end].sum()), low + begin, end - begin), key=lambda x: (x[0], -x[1]))
    return out


def enough(matching: int, length: int, n_words: int) -> bool:
    needed = min(NEEDED, -(-3 * n_words // 4)) if n_words >= SPAN else n_words
    return length > 0 and matching >= needed and 4 * matching >= 3 * length


def whole_item(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """As ``best_stretch``, of all of the item that lies on the words."""
    low, high = max(0, shift), min(len(words), shift + len(item))
    if high <= low:
        return 0, max(0, low), 0
    return int((words[low:high] == item[low - shift : high - shift]).sum()), low, high - low


def leaks(docs: DataFrame, items: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_words of the item,
    matching words, and the stretch of the document (first word and length)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sought = written(item_seeds(items, whole), "seeds")
    high = F.shiftright("seed", 32).alias("high")
    filters = bit_filter(sought.select("seed"), FILTER), bit_filter(sought.select(high), FILTER)
    # One of SPAN - SHORTEST lengths each.
    least = SHORTEST if whole else SPAN
    shorter = sorted(r["n_words"] for r in sought.where(F.col("n_words") < least).select("n_words").distinct().collect())
    masks = CLOSE_MASKS if whole else MASKS
    longest = sought.agg(F.max("n_words")).first()[0] or 0
    found = written(passages(docs, filters, shorter, min(longest, 4_096) + _SIDE, masks), "passages")
    found = found.withColumn("passage", F.xxhash64("doc_id", "before", "words"))
    hits = found.select("passage", F.explode(F.arrays_zip("seeds", "spots")).alias("hit"))
    hits = hits.select("passage", F.col("hit.seeds").alias("seed"), F.col("hit.spots").alias("spot"))
    laid = hits.join(sought, "seed").select("passage", "item_id", (F.col("spot") - F.col("place")).alias("shift")).distinct()
    laid = laid.join(found.select("passage", "doc_id", "before", "words").distinct(), "passage")
    laid = _with_items(laid, items)

    def run(batches):
        for batch in batches:
            data = [batch.column(c).to_pylist() for c in ("words", "item", "shift", "before")]
            keep, out = [], []
            for i, (words, item, shift, before) in enumerate(zip(*data)):
                words, item = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64)
                matching, begin, length = best_stretch(words, item, shift)
                held = enough(matching, length, len(item))
                if whole and not held:
                    matching, begin, length = whole_item(words, item, shift)
                    held = 4 * matching >= 3 * len(item)
                if held:
                    keep.append(i)
                    out.append((len(item), matching, before + begin, length))
            if keep:
                columns = [pa.array(c, pa.int32()) for c in zip(*out)]
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("item_id").take(at), *columns],
                    names=["doc_id", "item_id", "n_words", "matching", "first_word", "length"],
                )

    schema = "doc_id long, item_id long, n_words int, matching int, first_word int, length int"
    stretches = laid.mapInArrow(released(run), schema)
    best = F.max(F.struct("matching", (-F.col("first_word")).alias("early"), "length", "n_words")).alias("best")
    return stretches.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.n_words").alias("n_words"),
        F.col("best.matching").alias("matching"),
        (-F.col("best.early")).alias("first_word"),
        F.col("best.length").alias("length"),
    )


def _with_items(laid: DataFrame, items: DataFrame) -> DataFrame:
    words = _item_words(items).distinct().withColumnRenamed("item_id", "own_id")
    return laid.join(words, F.col("item_id").eqNullSafe(F.col("own_id"))).drop("own_id")


def over_documents(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no item, with all their columns. A row
    with a null doc_id goes if some such row holds one."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"), whole=True).select(F.col("doc_id").alias("leaked_id")).distinct()
    kept = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("leaked_id")), "left_anti")
    return kept.select(*(docs[name] for name in docs.columns))
