from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from framewitness.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector], label))
    by_id = {}
    for vec_id, vector, _ in kept:
        by_id[vec_id] = min(by_id.get(vec_id, vector), vector)
    seeds = [by_id[i] for i in sorted(by_id, key=lambda i: (i is None, i or 0))[:entries]]
    length = len(seeds[0])
    kept = [row for row in kept if len(row[1]) == length]
    seeds = [seed for seed in seeds if len(seed) == length]
    width = -(-length // parts)
    codes, errors, numbers = [""] * len(kept), [0] * len(kept), []
    for part in range(parts):
        points = [v[part * width : (part + 1) * width] for _, v, _ in kept]
        book = [seed[part * width : (part + 1) * width] for seed in seeds]

        def nearest(p):
            return min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(book))

        for _ in range(rounds):
            groups = defaultdict(list)
            for p in points:
                groups[nearest(p)[1]].append(p)
            book = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(book)]
        for at, p in enumerate(points):
            error, entry = nearest(p)
            codes[at] += f"{entry:02x}"
            errors[at] += error
        numbers += [str(x) for c in book for x in c]
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    labels = defaultdict(int)
    for (_, _, label), error in zip(kept, errors):
        labels[label] += error
    return sorted(
        ((i, c, e, labels[label], digest) for (i, _, label), c, e in zip(kept, codes, errors)), key=repr
    )


def rows(many=700, length=16, seed=2):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(length)] for _ in range(9)]
    out = []
    for i in range(many):
        vector = [x + draw.gauss(0, 0.05) for x in middles[i % 9]]
        if i % 7 == 0:
            vector = [round(x, 1) for x in vector]
        out.append((i * 3 % many, vector, None if i % 10 == 0 else i % 4))
    hot = out[5][1]
    out += [(many + i, hot, 9) for i in range(many // 2)]
    out += [
        (-5, None, 1), (-6, [None] * length, 1), (-7, [float("nan")] * length, 1), (-8, [float("inf")] * length, 1),
        (None, hot, None), (0, hot, 1), (0, hot, 1), (-3, [0.0] * length, 1), (99_999, [1.0], 1),
    ]
    draw.shuffle(out)
    return out


def got(df):
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", [8, 16, 20])
def test_digests(spark, length):
    data = rows(length=length)
    wide = [(*row, "x", 1) for row in data]
    df = spark.createDataFrame(wide, SCHEMA + ", code string, error int").repartition(3)
    assert got(vector_codes.digests(df)) == plain(data)


@pytest.mark.parametrize(("chunk", "entries"), [(10, 3), (100, 30), (5_000, 1)])
def test_chunks_and_entries(spark, chunk, entries):
    data = rows(400, 12)
    df = spark.createDataFrame(data, SCHEMA)
    found = vector_codes.compress(df, parts=4, entries=entries, rounds=3, chunk=chunk)
    codes = sorted(((r.vec_id, r.code, r.error) for r in found.rows.collect()), key=repr)
    assert codes == sorted((r[:3] for r in plain(data, 4, entries, 3)), key=repr)
    assert [len(book) for book in found.codebooks] == [entries] * 4


def test_few_and_no_vectors(spark):
    assert vector_codes.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.digests(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0
    data = [(1, [0.5] * 8, 1), (2, [-0.5] * 8, None), (None, [0.25] * 8, None)]
    assert got(vector_codes.digests(spark.createDataFrame(data, SCHEMA))) == plain(data)


def test_components_that_are_too_large(spark):
    df = spark.createDataFrame([(1, [3e38] * 8, 1)], SCHEMA)
    with pytest.raises(Exception, match="compared exactly"):
        vector_codes.digests(df).collect()


@pytest.mark.parametrize("seed", range(4))
def test_tree_balls(seed):
    draw = np.random.default_rng(seed)
    points = np.unique(draw.integers(-30, 30, (500, 3)), axis=0)
    weights = draw.integers(1, 5, len(points))
    tree = vector_codes._Tree(points, weights)
    row = tree.row(np.arange(len(points)))
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    ordered = points[tree.order]
    for i, node in enumerate(tree.nodes):
        inside = ordered[node["first"] : node["last"]]
        assert ((inside - node["center"]) ** 2).sum(1).max() == node["r2"]
        assert (inside * weights[tree.order][node["first"] : node["last"], None]).sum(0).tolist() == node["total"].tolist()
        if node["left"] >= 0:
            halves = tree.nodes[node["left"]], tree.nodes[node["right"]]
            assert (halves[0]["first"], halves[0]["last"], halves[1]["last"]) == (node["first"], halves[1]["first"], node["last"])
            assert i < min(node["left"], node["right"])
        else:
            assert len(inside) <= vector_codes.LEAF
    assert (ordered[row["place"]] == points).all()
