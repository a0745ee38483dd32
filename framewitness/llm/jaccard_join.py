"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct shingles of five words. Sizes are cut into bands with a
ratio of 1/0.75, so that similar sets are in the same band or in neighbouring ones; each
band is one instance, which its own sets and those of the band below take part in.

Signatures. In an instance the shingles' domain is cut into P partitions. Two similar
sets differ in at most k shingles, hence in at most k partitions; of a set's N partitions
that are not empty at least N - k are the same in the other. The enumerated subsets are
single partitions (PartEnum's second level of one). As N - k are common, any common
order of signatures lets each set keep its first k + 1 and still share one. The order is
by rarity, as a count-min sketch of all shingles of fixed size estimates it, so that a
passage in a third of all documents is in no signature unless a set has little else.
Sets of up to ``SMALL`` shingles get so many partitions that each holds one shingle.

Links. Groups with the same members count once. The first round verifies one pair per
set: with the smallest set it shares a signature with. The second verifies every set with
the smallest of each of its groups, the third the pairs of groups whose sets are still in
different components, which a link could join. No pair inside one component is looked at:
it can't change the result. The third round leaves out, inside a task, the pairs that a
parity sketch excludes: each shingle flips one bit, so that two sketches differ in no more
bits than the sets do in shingles. Groups above ``BLOCK`` sets are compared block by
block. Pairs are verified exactly, with the shingles of the whole texts; a set that many
pairs need is copied to slices of them.

Defined results: words are runs of other characters than ``[\\x20\\x09-\\x0D]``, A-Z in
lower case; under five words the whole sequence is one shingle; without words (null,
empty, blank) the set is empty and links with nothing; rows of one doc_id are in one
component; rows with a null doc_id link like others, but never name a component unless
it has none but such rows, which is null then; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.components import linked
from framewitness.llm.kernels import Rolling, lower_ascii, mixed, text_blocks, word_hashes, word_spans
from framewitness.llm.shared import only_text, parts, released, table, written

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact.
SIMILAR = (3, 4)
#: Up to this size each partition of the domain holds one shingle.
SMALL = 128
#: Counters of the sketch that the order of signatures comes from.
CELLS = 1 << 20
#: Pairs that one copy of a text serves.
SLICE = 500
#: Sets of a group that are compared in one task.
BLOCK = 20_000
#: Documents whose numbers may be broadcast, two of 8 bytes at most; beyond it a join is shuffled.
FEW = 1_000_000


def _blocks(batch, name="text"):
    order = pa.array(np.arange(batch.num_rows))
    for places, buffer, bounds in text_blocks(order, batch.column(name)):
        yield places.to_numpy(), lower_ascii(buffer), bounds


def shingles(buffer, bounds, words: int = WORDS):
    """Distinct shingle hashes of the texts of a block, text by text, and their offsets."""
    starts, ends, at = word_spans(buffer, bounds)
    rolling = Rolling(word_hashes(buffer, starts, ends))
    counts = np.diff(at)
    grams = rolling.every(words)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    inside = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(counts - words + 1, 0)) - np.maximum(counts - words + 1, 0), np.maximum(counts - words + 1, 0))
    values = grams[at[:-1][text] + inside] if len(text) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        text = np.concatenate([text, short])
        values = np.concatenate([values, rolling.of(at[short], at[short + 1])])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    text, values = text[new], values[new]
    return values, np.searchsorted(text, np.arange(len(counts) + 1))


def set_keys(values, cuts):
    """A 64-bit hash of each set, by two sums over its members; 0 for an empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(values), dtype=np.uint64))
    more = np.append(np.uint64(0), np.cumsum(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
    first, second = sums[cuts[1:]] - sums[cuts[:-1]], more[cuts[1:]] - more[cuts[:-1]]
    return first.view(np.int64), second.view(np.int64)


def bands(similar=SIMILAR, most: int = 1 << 40) -> np.ndarray:
    """The largest size of each band."""
    num, den = similar
    tops, low = [], 1
    while low < most:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return np.array(tops)


_TOPS = bands()


def differing(size, other):
    """The most shingles in which similar sets of these sizes differ: |x| + |y| - 2|x & y|,
    where |x & y| is at least 3/7 of both sizes."""
    return (size + other) // 7


def partitions(top: np.ndarray) -> np.ndarray:
    """Partitions of the domain for an instance with sets up to this size.

    The fewer, the more a signature says; but more than k of a set's must hold a shingle.
    The expected surplus is seven standard deviations or more; up to SMALL it is certain.
    """
    most = differing(top, top)
    share = np.where(most >= 97, 1.3, np.where(most >= 49, 1.6, 2.0))
    return np.where(top <= SMALL, 1 << 40, np.ceil(share * (most + 1))).astype(np.uint64)


def parity_sketches(values, cuts) -> list[bytes]:
    """One bit string per set, about four times as many bits as shingles: each flips one."""
    sizes = np.diff(cuts)
    bits = 64 * (1 << np.ceil(np.log2(np.maximum(sizes, 16) / 16)).astype(int))
    base = np.append(0, np.cumsum(bits))
    text = np.repeat(np.arange(len(sizes)), sizes)
    spot = mixed(values ^ np.uint64(0x5C5C5C5C5C5C5C5C)) & (bits[text] - 1).astype(np.uint64)
    flips = np.bincount(base[text] + spot.astype(np.int64), minlength=base[-1]) & 1
    packed = np.packbits(flips.astype(np.uint8)).tobytes()
    return [packed[a:b] for a, b in zip(base // 8, base[1:] // 8)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch with fewer bits: both halves over each other, as often as needed."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def signatures(values, cuts, rank):
    """(text, signature) of all sets of a block; ``rank`` is how common a shingle is."""
    sizes = np.diff(cuts)
    band = np.searchsorted(_TOPS, sizes)
    for step in (0, 1):
        instance = band + step
        top = _TOPS[instance]
        other = top if step == 0 else np.minimum(top, sizes * SIMILAR[1] // SIMILAR[0])
        most = differing(sizes, other)
        # The same for all sets of an instance: it follows from the band's largest size.
        cells = partitions(top)
        text = np.repeat(np.arange(len(sizes)), sizes)
        part = mixed(values + instance[text].astype(np.uint64)) % cells[text]
        order = np.lexsort((part, text))
        text, part, some, common = text[order], part[order], values[order], rank[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(new)
        if not len(heads):
            continue
        token = np.add.reduceat(mixed(some), heads)
        token = mixed(token ^ mixed(part[heads] * np.uint64(64) + instance[text[heads]].astype(np.uint64)))
        common, text = np.minimum.reduceat(common, heads), text[heads]
        order = np.lexsort((token, common, text))
        token, text = token[order], text[order]
        begin = np.searchsorted(text, np.arange(len(sizes)))
        place = np.arange(len(text)) - begin[text]
        keep = place <= most[text]
        yield text[keep], token[keep]


def sketch(docs: DataFrame) -> np.ndarray:
    """How common shingles are, from counts of all of them in ``CELLS`` cells: the binary
    logarithm over the mean. Only the order of signatures depends on it."""

    def count(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, buffer, bounds in _blocks(batch):
                values, _ = shingles(buffer, bounds)
                counts += np.bincount((values >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
        size = CELLS // 64
        for block in range(64):
            part = counts[block * size : (block + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.astype(np.uint32).tobytes()], pa.binary())})

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                merged[block] = merged.get(block, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        for block, part in merged.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    merged = docs.select("text").mapInArrow(released(count), schema).repartition(parts(docs.sparkSession), "block")
    counts = np.zeros((64, CELLS // 64), np.int64)
    for row in merged.mapInArrow(released(merge), schema).collect():  # 64 blocks of a fixed size
        counts[row["block"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.ravel()
    return np.log2(1 + counts / max(1.0, counts.mean())).astype(np.uint8)


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text and the node: the doc_id, or for null a number from the text."""
    docs = only_text(docs)
    return docs.withColumn("node", F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3))))


def sizes_and_keys(docs: DataFrame) -> DataFrame:
    """One narrow row per document: node, n_shingles, hashes and sketch of its set."""

    def run(batches):
        for batch in batches:
            for at, buffer, bounds in _blocks(batch):
                values, cuts = shingles(buffer, bounds)
                first, second = set_keys(values, cuts)
                rows = slice(int(at[0]), int(at[-1]) + 1)
                size = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, size), batch.column("node").slice(rows.start, size)]
                    + [pa.array(np.diff(cuts), pa.int64()), pa.array(first), pa.array(second)]
                    + [pa.array(parity_sketches(values, cuts), pa.binary())],
                    names=["doc_id", "node", "n_shingles", "h1", "h2", "sketch"],
                )

    schema = "doc_id long, node long, n_shingles long, h1 long, h2 long, sketch binary"
    return docs.mapInArrow(released(run), schema)


def groups(docs: DataFrame) -> DataFrame:
    """The groups of documents with a common signature, equal ones once: token, node and
    pivot, the smallest node."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch(docs))
    n = parts(spark)
    buckets = 8 * n

    def emit(batches):
        seen: set[int] = set()  # one of equal sets is enough, the others are its copies
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at, buffer, bounds in _blocks(batch):
                values, cuts = shingles(buffer, bounds)
                first, _ = set_keys(values, cuts)
                fresh = np.diff(cuts) > 0
                for i, key in enumerate(first.tolist()):
                    if fresh[i]:
                        fresh[i] = key not in seen
                        seen.add(key)
                take = np.repeat(fresh, np.diff(cuts))
                values = values[take]
                cuts = np.append(0, np.cumsum(np.diff(cuts)[fresh]))
                own = nodes[at[fresh]]
                rank = sent.value[(values >> np.uint64(20)).astype(np.int64) & (CELLS - 1)]
                found = list(signatures(values, cuts, rank)) if len(values) else []
                if found:
                    text, token = (np.concatenate(x) for x in zip(*found))
                    bucket = ((token >> np.uint64(48)) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    text, token, bucket = text[order], token[order], bucket[order]
                    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    ends = np.append(heads, len(bucket))
                    blobs = [
                        (token[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                        + (token[a:b] >> np.uint64(32)).astype("<u2").tobytes()
                        + own[text[a:b]].tobytes()
                        for a, b in zip(ends, ends[1:])
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[heads]), pa.array(np.diff(ends), pa.int32()), pa.array(blobs, pa.binary())],
                        names=["bucket", "n", "blob"],
                    )

    def gather(batches):
        tokens, nodes, own = [], [], []
        for batch in batches:
            for bucket, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "blob"))):
                low = np.frombuffer(blob, "<u4", n).astype(np.uint64)
                high = np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64)
                tokens.append(low | high << np.uint64(32))
                nodes.append(np.frombuffer(blob, "<i8", n, 6 * n))
                own.append(np.full(n, bucket, np.int32))
        if not tokens:
            return
        tokens, nodes, own = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(own)
        order = np.lexsort((nodes, tokens, own))
        tokens, nodes, own = tokens[order], nodes[order], own[order]
        group = np.ones(len(tokens), bool)
        group[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
        new = group.copy()
        new[1:] |= nodes[1:] != nodes[:-1]
        nodes, group = nodes[new], np.flatnonzero(group[new])
        counts = np.diff(np.append(group, len(nodes)))
        # A group is known by its members, so that many signatures make one group.
        tokens = mixed(np.add.reduceat(mixed(nodes.view(np.uint64)), group) + counts.astype(np.uint64))
        several = np.flatnonzero(counts > 1)
        several = several[np.unique(tokens[several], return_index=True)[1]]
        for begin in range(0, len(several), 1 << 16):
            wide = several[begin : begin + (1 << 16)]
            sizes = counts[wide]
            inside = np.repeat(group[wide] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(tokens[wide], sizes).view(np.int64)), pa.array(nodes[inside]), pa.array(np.repeat(nodes[group[wide]], sizes))],
                names=["token", "node", "pivot"],
            )

    packed = docs.mapInArrow(released(emit), "bucket int, n int, blob binary").repartition(n, "bucket")
    return packed.mapInArrow(released(gather), "token long, node long, pivot long")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar; v may be in many of them."""
    n = parts(texts.sparkSession)
    texts = texts.repartition(n, "node")
    pairs = written(pairs.select("u", "v").distinct(), "pairs")
    often = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    right = (
        texts.join(often.withColumnRenamed("v", "node").hint("shuffle_hash"), "node")
        .select(F.col("node").alias("v"), F.col("text").alias("right"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    )
    # Hardly any v has more than one slice: a SLICE-th of the pairs at most.
    left = pairs.join(F.broadcast(often.where("slices > 1")), "v", "left")
    left = left.select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    left = texts.join(left.withColumnRenamed("u", "node").hint("shuffle_hash"), "node").select(
        F.col("node").alias("u"), "v", "slice", F.col("text").alias("left")
    )

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            same = np.zeros(rows, bool)
            for a in range(0, rows, 256):
                some = batch.slice(a, min(256, rows - a))
                sets = [_sets(some.column(c)) for c in ("left", "right")]
                for i, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    # |x & y| / |x | y| >= 3/4, in whole numbers
                    same[a + i] = both > 0 and SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(pa.array(same)), batch.column("v").filter(pa.array(same))], names=["u", "v"]
            )

    both = left.join(right, ["v", "slice"]).select("u", "v", "left", "right")
    return both.mapInArrow(released(run), "u long, v long")


def _sets(texts) -> list[np.ndarray]:
    out = []
    for _, buffer, bounds in text_blocks(pa.array(np.arange(len(texts))), texts):
        values, cuts = shingles(lower_ascii(buffer), bounds)
        out += [values[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def _few(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast up to ``FEW`` of them."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are in different components so far."""
    left = roots.select(F.col("node").alias("u"), F.col("root").alias("u_root"))
    right = roots.select(F.col("node").alias("v"), F.col("root").alias("v_root"))
    pairs = pairs.join(left, "u", "left").join(right, "v", "left")
    return pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def across_components(labelled: DataFrame) -> DataFrame:
    """Pairs of one group in different components that sizes and sketches allow: (u, v).

    ``labelled`` has token, node, root, least, most, sketch (null: any) and blocks, of which
    the group is to be cut into so many.
    """
    spark = labelled.sparkSession
    units = labelled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = units.withColumn("other", other).select(
        "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "node", "root", "least", "most", "sketch",
    )

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.concat_tables(tables).combine_chunks()
        order = np.lexsort(tuple(rows[c].to_numpy() for c in ("high", "low", "token")))
        token, low, high, own, node, root, least, most = (
            rows[c].to_numpy()[order]
            for c in ("token", "low", "high", "own", "node", "root", "least", "most")
        )
        sketches = rows["sketch"].take(pa.array(order)).to_pylist()
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cuts = np.append(np.flatnonzero(new), len(token)).tolist()
        pairs = []
        for a, b in zip(cuts, cuts[1:]):
            known = np.array([x is not None for x in sketches[a:b]])
            words = min((len(x) // 8 for x in sketches[a:b] if x is not None), default=1)
            bits = np.stack([folded(x, words) if x is not None else np.zeros(words, np.uint64) for x in sketches[a:b]])
            found = []
            for i in range(b - a - 1):
                j = slice(a + i + 1, b)
                num, den = SIMILAR
                fits = (root[j] != root[a + i]) & (num * least[j] <= den * most[a + i]) & (num * least[a + i] <= den * most[j])
                if low[a] != high[a]:
                    fits &= own[j] != own[a + i]
                at = np.flatnonzero(fits)
                if len(at):
                    apart = np.bitwise_count(bits[i + 1 + at] ^ bits[i]).sum(1)
                    near = apart <= differing(most[a + i], most[j][at])
                    at = at[near | ~known[i] | ~known[i + 1 + at]]
                    found.append(np.stack([np.full(len(at), i), i + 1 + at]))
            if found:
                pairs.append(np.sort(node[a:b][np.concatenate(found, 1)], 0))
            if pairs and (b == len(token) or sum(x.shape[1] for x in pairs) > 1 << 20):
                # Groups of one neighbourhood find the same pairs.
                one, two = np.unique(np.concatenate(pairs, 1), axis=1)
                pairs = []
                yield pa.RecordBatch.from_arrays([pa.array(two), pa.array(one)], names=["u", "v"])

    dealt = units.repartition(parts(spark), "token", "low", "high")
    return dealt.mapInArrow(released(run), "u long, v long").distinct()


def links(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """Components of the similarity graph over nodes: (node, root) of those that are no root."""
    full = narrow.where("n_shingles > 0")
    classes = full.groupBy("h1", "h2", "n_shingles").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Copies are linked with the smallest of them and need no verification.
    copies = full.join(classes, ["h1", "h2", "n_shingles"]).select(F.col("node").alias("u"), F.col("rep").alias("v"))
    rep = written(copies.where("u <> v"), "copies")
    reps = written(rep.groupBy("u").agg(F.min("v").alias("v")), "reps")
    found = groups(docs)
    if reps.count() <= FEW:
        reps = F.broadcast(reps)
    else:
        found = found.distinct()  # else shuffled twice more, before it is distinct below
    found = found.join(reps.withColumnRenamed("u", "node"), "node", "left")
    found = found.select("token", F.coalesce("v", "node").alias("node"), "pivot")
    found = found.join(reps.withColumnRenamed("u", "pivot"), "pivot", "left")
    found = written(found.select("token", "node", F.coalesce("v", "pivot").alias("pivot")).distinct(), "groups")
    size = full.groupBy("node").agg(
        F.min("n_shingles").alias("least"),
        F.max("n_shingles").alias("most"),
        F.when(F.count(F.lit(1)) == 1, F.first("sketch")).alias("sketch"),
    )
    # A pivot is one of its group's nodes.
    needed = _few(written(found.select("node").distinct(), "needed"))
    texts = written(docs.select("node", "text").join(needed, "node", "left_semi"), "texts")
    stars = found.where("node <> pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
    stars = written(_possible(stars.distinct(), size), "stars")
    first = stars.groupBy("u").agg(F.min("v").alias("v"))
    roots = linked(rep.unionByName(verified(texts, first)))
    rest = stars.join(first.withColumnRenamed("v", "first"), "u").where("v <> first").select("u", "v")
    more = verified(texts, _between(rest, _few(roots)))
    # The components so far are links as good as those they come of, and fewer.
    roots = linked(_links(roots).unionByName(more))
    # Groups that still hold several components, all pairs across them but the stars.
    labelled = found.select("token", "node").join(_few(roots), "node", "left")
    labelled = labelled.select("token", "node", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("token").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    labelled = labelled.join(several.where("a <> b").select("token", "blocks"), "token")
    across = across_components(labelled.join(size, "node")).join(stars, ["u", "v"], "left_anti")
    return linked(_links(roots).unionByName(verified(texts, across)))


def _links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _possible(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    u = size.select(F.col("node").alias("u"), F.col("least").alias("u_least"), F.col("most").alias("u_most"))
    v = size.select(F.col("node").alias("v"), F.col("least").alias("v_least"), F.col("most").alias("v_most"))
    num, den = SIMILAR
    fits = f"{num} * v_least <= {den} * u_most AND {num} * u_least <= {den} * v_most"
    return pairs.join(u, "u").join(v, "v").where(fits).select("u", "v")


def joined(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    docs = _nodes(docs)
    narrow = written(sizes_and_keys(docs), "sizes")
    rows = narrow.join(_few(links(docs, narrow)), "node", "left").select(
        "doc_id", "node", "n_shingles", F.coalesce("root", "node").alias("root")
    )
    if not narrow.where("doc_id IS NULL").head(1):
        return rows.select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    # A node made for a null doc_id names nothing: the smallest real one does.
    names = rows.where("doc_id IS NULL").select("root").distinct()
    names = rows.join(names, "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("name"), F.lit(True).alias("renamed"))
    rows = rows.join(names, "root", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("renamed"), F.col("name")).otherwise(F.col("root")).alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest doc_id of each component stays.

    Documents with an empty set, and those with a null doc_id, are groups of their own
    and stay.
    """
    found = joined(docs).where("component_id IS NOT NULL AND doc_id <> component_id")
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
