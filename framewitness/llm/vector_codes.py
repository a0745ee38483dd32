"""Vector code compression: product codes by exact k-means over metric trees.

Components become whole numbers, vectors are cut into equal parts, and each part has a
codebook, refined by rounds of k-means. All arithmetic is on 64-bit whole numbers, so the
result does not depend on partitions or on the order of addition.

*Anchors hierarchy.* Each task cuts its vectors into chunks of ``CHUNK`` and builds one
tree a part over a chunk's different points, from the middle out: about the square root
of the points become anchors, each new one the farthest point of the widest anchor,
stealing what is nearer to it (points less than half the way from their own anchor can't
be, by the triangle inequality, and are not looked at). Anchors are then merged upwards,
the pair with the smallest common ball first, and grown downwards in the same way. Every
ball caches the sum and the number of its vectors. Trees do not depend on the codebooks:
they are built once and written to the shared folder.

*Rounds.* A round walks the trees from their roots. A ball inherits the entries that may
own points of its parent, and loses each that another one beats everywhere in the ball
(a linear bound, with a margin for rounding on the side of keeping). Once one entry is
left, the cached sum and count are added to it without looking at any point; in a leaf
the points are compared with the entries left. Tasks send one row for each component of
each entry, so a round shuffles and collects entries * width rows a task at most,
whatever the number of vectors.

Defined results: vectors that are null or hold null, NaN or infinite components are left
out, and so are those whose length differs from that of the smallest vec_id; a null
vec_id comes after all others; of repeated vec_ids the smallest vector stands in the
first codebook, and every row gets a code; fewer vec_ids than entries make a smaller
codebook; parts are rounded up to whole components if the length is not a multiple of
their number, the last ones being shorter; an empty table gives an empty result. Other
columns are left out. Components whose squared distances would not fit into 64 bits are
an error.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.shared import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
#: Vectors of a tree, and different points of a leaf.
CHUNK, LEAF = 1_024, 32
#: Points whose distances to all entries are worked out at a time.
_SLICE = 1 << 15
_MARGIN = 1 + 1e-9


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the vector in whole numbers, for vectors that are finite."""
    fine = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return embeddings.where(F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", whole.cast("array<long>").alias("vector")
    )


def first_entries(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest vec_ids; a task sends one id for each entry at most."""

    def smallest(batches):
        known, null = np.empty(0, np.int64), False
        for batch in batches:
            ids = batch.column("vec_id")
            null |= ids.null_count > 0
            known = np.union1d(known, ids.drop_null().to_numpy(zero_copy_only=False))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array([*known.tolist(), *[None] * null], pa.int64())], names=["vec_id"])

    first = F.col("vec_id").asc_nulls_last()
    sent = vectors.select("vec_id").mapInArrow(smallest, "vec_id long").distinct()
    ids = [row["vec_id"] for row in sent.orderBy(first).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        chosen = chosen | F.col("vec_id").isNull()
    merged = vectors.where(chosen).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return [row["vector"] for row in merged.orderBy(first).collect()]


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for component in range(points.shape[1]):
        out += (points[:, component, None] - entries[None, :, component]) ** 2
    return out


class _Tree:
    """Anchors hierarchy over different points with weights."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points, weights
        self.nodes: list[dict] = []
        self.order: list[np.ndarray] = []
        self.placed = 0
        root = self._grown(np.arange(len(points)))
        self._laid_out(root)
        self.order = np.concatenate(self.order)

    def _ball(self, members: np.ndarray) -> dict:
        points, weights = self.points[members], self.weights[members, None]
        total, count = (points * weights).sum(0), int(weights.sum())
        center = total // count
        return {
            "members": members, "total": total, "count": count, "center": center,
            "r2": int(((points - center) ** 2).sum(1).max()), "pair": None,
        }

    def _grown(self, members: np.ndarray) -> dict:
        if len(members) <= LEAF:
            return self._ball(members)
        return self._merged([self._grown(owned) for owned in self._anchors(members)])

    def _anchors(self, members: np.ndarray) -> list[np.ndarray]:
        points = self.points[members]
        pivots = [0]
        owner = np.zeros(len(points), np.int64)
        distance = ((points - points[0]) ** 2).sum(1)
        while len(pivots) ** 2 < len(points) or len(pivots) < 2:
            # The farthest point of all belongs to the widest anchor.
            new = int(distance.argmax())
            between = ((points[pivots] - points[new]) ** 2).sum(1)
            reach = np.flatnonzero(4 * distance > between[owner])
            nearer = ((points[reach] - points[new]) ** 2).sum(1)
            stolen = nearer < distance[reach]
            owner[reach[stolen]], distance[reach[stolen]] = len(pivots), nearer[stolen]
            pivots.append(new)
        return [members[owner == anchor] for anchor in range(len(pivots))]

    def _merged(self, balls: list[dict]) -> dict:
        centers = np.array([ball["center"] for ball in balls], np.float64)
        radii = np.sqrt([float(ball["r2"]) for ball in balls])
        alive = np.ones(len(balls), bool)

        def common(at):
            away = np.sqrt(((centers - centers[at]) ** 2).sum(1))
            radius = np.maximum(np.maximum(radii, radii[at]), (away + radii + radii[at]) / 2)
            return np.where(alive & (np.arange(len(radii)) != at), radius, np.inf)

        cost = np.array([common(at) for at in range(len(balls))])
        for _ in range(len(balls) - 1):
            one, other = divmod(int(cost.argmin()), len(balls))
            pair = balls[one], balls[other]
            ball = self._ball(np.concatenate([pair[0]["members"], pair[1]["members"]]))
            ball["pair"] = pair
            balls[one] = ball
            centers[one], radii[one] = ball["center"], np.sqrt(float(ball["r2"]))
            alive[other] = False
            cost[other, :] = cost[:, other] = np.inf
            cost[one, :] = cost[:, one] = common(one)
        return ball

    def _laid_out(self, ball: dict) -> int:
        """Number the balls from the root on, each before those in it, and give each a
        run of points."""
        at, first = len(self.nodes), self.placed
        self.nodes.append(ball)
        ball["left"] = ball["right"] = -1
        if ball["pair"] is None:
            self.order.append(ball["members"])
            self.placed += len(ball["members"])
        else:
            ball["left"], ball["right"] = (self._laid_out(child) for child in ball["pair"])
        ball["first"], ball["last"] = first, self.placed
        return at

    def row(self, inverse: np.ndarray) -> dict:
        """The tree as lists; ``place`` leads from a vector to its point."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        lists = {name: [node[name] for node in self.nodes] for name in ("r2", "count", "left", "right", "first", "last")}
        return lists | {
            "center": np.concatenate([node["center"] for node in self.nodes]),
            "total": np.concatenate([node["total"] for node in self.nodes]),
            "points": self.points[self.order].ravel(),
            "weight": self.weights[self.order],
            "place": place[inverse],
        }


_LISTS = {
    "center": "int", "r2": "long", "total": "long", "count": "long", "left": "int", "right": "int",
    "first": "int", "last": "int", "points": "int", "weight": "long", "place": "int",
}
_TREE = "array<struct<" + ", ".join(f"{name}: array<{kind}>" for name, kind in _LISTS.items()) + ">>"


def _tree_arrays(rows: list[dict]) -> pa.StructArray:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = []
    for name, kind in _LISTS.items():
        values = [np.asarray(row[name], np.int64) for row in rows]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        flat = pa.array(np.concatenate(values)).cast(kinds[kind])
        fields.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
    return pa.StructArray.from_arrays(fields, names=list(_LISTS))


def _widths(length: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part in a vector."""
    width = -(-length // parts)
    return [(min(p * width, length), min((p + 1) * width, length)) for p in range(parts)]


def _builder(length: int, parts: int, chunk: int):
    # Differences are below twice the limit; their squares must add up in 63 bits.
    limit = int(np.sqrt((1 << 60) / max(1, length)) / 2)
    limit = min(limit, (1 << 31) - 1)

    def row(ids, labels, vectors):
        if len(vectors) and np.abs(vectors).max() > limit:
            raise ValueError(f"components beyond {limit} can't be compared exactly")
        rows = []
        for begin, end in _widths(length, parts):
            points, inverse, weights = np.unique(vectors[:, begin:end], axis=0, return_inverse=True, return_counts=True)
            rows.append(_Tree(points, weights).row(inverse.ravel()))
        trees = _tree_arrays(rows)
        one = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(one, ids),
                pa.ListArray.from_arrays(one, labels),
                pa.ListArray.from_arrays(pa.array([0, parts], pa.int32()), trees),
            ],
            names=["vec_id", "label", "trees"],
        )

    def build(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            while rest.num_rows >= chunk:
                yield made(rest.slice(0, chunk))
                rest = rest.slice(chunk)
        if rest is not None and rest.num_rows:
            yield made(rest)

    def made(rows):
        rows = rows.combine_chunks()
        ids, labels, vectors = (rows.column(n).combine_chunks() for n in ("vec_id", "label", "vector"))
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return row(ids, labels, flat.reshape(len(ids), length))

    return build


class _Forest:
    """The trees of one part in a batch, as flat arrays with common numbering."""

    def __init__(self, trees: pa.StructArray, part: int, parts: int, width: int):
        mine = trees.take(pa.array(np.arange(part, len(trees), parts)))
        lists = {name: mine.field(name) for name in _LISTS}
        flat = {n: v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n, v in lists.items()}
        sizes = {n: np.diff(v.offsets.to_numpy()) for n, v in lists.items()}
        nodes, points = sizes["r2"], sizes["weight"]
        self.roots = np.cumsum(nodes) - nodes
        node_base = np.repeat(self.roots, nodes)
        point_start = np.cumsum(points) - points
        point_base = np.repeat(point_start, nodes)
        self.center = flat["center"].reshape(-1, width) if width else np.zeros((nodes.sum(), 0), np.int64)
        self.total = flat["total"].reshape(-1, width) if width else np.zeros((nodes.sum(), 0), np.int64)
        self.points = flat["points"].reshape(-1, width) if width else np.zeros((points.sum(), 0), np.int64)
        self.r2, self.count, self.weight = flat["r2"].astype(np.float64), flat["count"], flat["weight"]
        self.left = np.where(flat["left"] < 0, -1, flat["left"] + node_base)
        self.right = np.where(flat["right"] < 0, -1, flat["right"] + node_base)
        self.first, self.last = flat["first"] + point_base, flat["last"] + point_base
        self.place = flat["place"] + np.repeat(point_start, sizes["place"])

    def walk(self, entries: np.ndarray):
        """Yields ("ball", nodes, entry of each) and ("points", points, entry of each)."""
        apart = _squared(entries, entries).astype(np.float64)
        far = np.iinfo(np.int64).max
        nodes, may = self.roots, np.ones((len(self.roots), len(entries)), bool)
        while len(nodes):
            away = _squared(self.center[nodes], entries)
            best = np.where(may, away, far).argmin(1)
            lead = (away - away[np.arange(len(nodes)), best, None]).astype(np.float64)
            beaten = lead**2 > 4 * self.r2[nodes, None] * apart[best] * _MARGIN
            may &= ~(beaten & (lead > 0))
            owned = may.sum(1) == 1
            if owned.any():
                yield "ball", nodes[owned], best[owned]
            leaf = ~owned & (self.left[nodes] < 0)
            yield from self._leaves(nodes[leaf], may[leaf], entries, far)
            inner = ~owned & ~leaf
            # What is left of the entries is inherited by both halves.
            nodes, may = np.concatenate([self.left[nodes[inner]], self.right[nodes[inner]]]), np.tile(may[inner], (2, 1))

    def _leaves(self, nodes, may, entries, far):
        sizes = self.last[nodes] - self.first[nodes]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(nodes):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _SLICE, "right")))
            some = slice(begin, stop)
            points = _runs(self.first[nodes[some]], sizes[some])
            away = np.where(np.repeat(may[some], sizes[some], axis=0), _squared(self.points[points], entries), far)
            # argmin takes the first, which is the lower index.
            yield "points", points, away.argmin(1)
            begin = stop

    def sums(self, entries: np.ndarray):
        """Component sums and counts of the points of each entry."""
        total = np.zeros_like(entries)
        count = np.zeros(len(entries), np.int64)
        for kind, which, entry in self.walk(entries):
            weights = self.count[which] if kind == "ball" else self.weight[which]
            values = self.total[which] if kind == "ball" else self.points[which] * weights[:, None]
            np.add.at(total, entry, values)
            np.add.at(count, entry, weights)
        return total, count

    def assigned(self, entries: np.ndarray):
        """Entry and squared distance of each vector."""
        owner = np.zeros(len(self.points), np.int64)
        for kind, which, entry in self.walk(entries):
            if kind == "ball":
                sizes = self.last[which] - self.first[which]
                owner[_runs(self.first[which], sizes)] = np.repeat(entry, sizes)
            else:
                owner[which] = entry
        error = ((self.points - entries[owner]) ** 2).sum(1)
        return owner[self.place], error[self.place]


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, each from its first on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def _trees_of(batch):
    return batch.column("trees").flatten()


class Codes(NamedTuple):
    """``rows``: vec_id, label, code (two hex digits a part) and error of each vector.
    ``codebooks``: for each part the entries, each a list of whole numbers."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def compress(
    embeddings: DataFrame,
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    chunk: int = CHUNK,
) -> Codes:
    """Train the codebooks on all vectors and give every vector its code."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = whole_vectors(embeddings, scale)
    label = dict(embeddings.dtypes)["label"]
    shape = f"vec_id long, label {label}, code string, error long"
    seeds = first_entries(vectors, entries)
    if not seeds:
        return Codes(embeddings.sparkSession.createDataFrame([], shape), [[] for _ in range(parts)])
    length = len(seeds[0])
    seeds = [seed for seed in seeds if len(seed) == length]
    spans = _widths(length, parts)
    books = [np.array([seed[a:b] for seed in seeds], np.int64).reshape(len(seeds), b - a) for a, b in spans]
    trees = written(
        vectors.where(F.size("vector") == length).mapInArrow(
            _builder(length, parts, chunk), f"vec_id array<long>, label array<{label}>, trees {_TREE}"
        ),
        "vector-trees",
    )
    for _ in range(rounds):
        books = _refined(trees, books)

    def code(batches):
        for batch in batches:
            forests = _trees_of(batch)
            found = [_Forest(forests, p, parts, b - a).assigned(books[p]) for p, (a, b) in enumerate(spans)]
            digits = np.stack([entry for entry, _ in found], 1).astype(np.uint8).tobytes().hex()
            wide = 2 * parts
            codes = [digits[i : i + wide] for i in range(0, len(digits), wide)]
            error = np.sum([error for _, error in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").flatten(), batch.column("label").flatten(), pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return Codes(trees.mapInArrow(code, shape), [book.tolist() for book in books])


def _refined(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of its parts."""

    def sums(batches):
        total = [np.zeros_like(book) for book in books]
        count = [np.zeros(len(book), np.int64) for book in books]
        for batch in batches:
            forests = _trees_of(batch)
            for part, book in enumerate(books):
                more, many = _Forest(forests, part, len(books), book.shape[1]).sums(book)
                total[part] += more
                count[part] += many
        rows = [
            (part, entry, position, int(total[part][entry, position]), int(count[part][entry]))
            for part, book in enumerate(books)
            for entry in np.flatnonzero(count[part]).tolist()
            for position in range(book.shape[1])
        ]
        names = ["part", "entry", "position", "total", "many"]
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    sent = trees.select("trees").mapInArrow(sums, "part int, entry int, position int, total long, many long")
    merged = sent.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("many").alias("many"))
    out = [book.copy() for book in books]
    for row in merged.collect():
        out[row["part"]][row["entry"], row["position"]] = row["total"] // row["many"]
    return out


def digests(embeddings: DataFrame) -> DataFrame:
    """The contract's row for each vector."""
    found = compress(embeddings)
    rows = written(found.rows, "vector-codes")
    numbers = ",".join(str(x) for book in found.codebooks for entry in book for x in entry)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("sum_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["sum_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def over_embeddings(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same rounds by comparing every part with every entry."""
    away = "list_sum(list_transform(list_zip(p.v, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for turn in range(ROUNDS + 1):
        steps.append(f"""near{turn} AS MATERIALIZED (
  SELECT p.id, p.part, min({{'d': {away}::BIGINT, 'entry': e.entry}}) AS best
  FROM pieces p JOIN book{turn} e ON p.part = e.part GROUP BY p.id, p.part
)""")
        if turn < ROUNDS:
            steps.append(f"""book{turn + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(means.c, old.c) AS c FROM book{turn} old LEFT JOIN (
    SELECT part, entry, list((total - ((total % many) + many) % many) // many ORDER BY position) AS c FROM (
      SELECT p.part, n.best.entry AS entry, i AS position, sum(p.v[i])::BIGINT AS total, count(*) AS many
      FROM pieces p JOIN near{turn} n ON p.id = n.id AND p.part = n.part, unnest(range(1, len(p.v) + 1)) u(i)
      GROUP BY ALL) GROUP BY part, entry) means USING (part, entry)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
  FROM kept, range({PARTS}) r(part)
), book0 AS MATERIALIZED (
  SELECT part, entry, v AS c FROM pieces JOIN (
    SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})) USING (id)
), {', '.join(steps)}, coded AS (
  SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY id
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (id), digest
"""


ORACLE = _oracle()
