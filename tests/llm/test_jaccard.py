from __future__ import annotations

import random

import numpy as np

from framewitness.llm import jaccard_join
from framewitness.llm.components import components
from tests.llm.edge import frame, got, rows, words

_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_sets(data):
    out = []
    for _, t in data:
        w = words((t or "").translate(_LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def plain(data):
    sets, parent = plain_sets(data), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            alike = both and 100 * both >= 75 * len(sets[a] | sets[b])
            if alike or (data[a][0] is not None and data[a][0] == data[b][0]):
                parent[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, len(s), names.get(find(k))) for k, ((i, _), s) in enumerate(zip(data, sets))), key=repr)


def made(seed, count=160):
    pick = random.Random(seed)
    hot = " ".join(f"hot{i}" for i in range(14))
    bases = [[f"v{pick.randrange(300)}" for _ in range(n)] for n in (3, 6, 9, 20, 40, 80, 200, 400)]
    data = []
    for i in range(count):
        text = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 2, 4, 8]) * max(1, len(text) // 100)):
            text[pick.randrange(len(text))] = pick.choice(["Edit", "edit", f"e{pick.randrange(9)}"])
        if pick.random() < 0.4:
            text = hot.split() + text
        data.append((i, pick.choice([" ", "\n"]).join(text)))
    return data


NAMES = ("doc_id", "n_shingles", "component_id")


def test_components_are_exact(spark):
    data = made(1) + [(None if i is None else i + 1_000, t) for i, t in rows()]
    assert got(jaccard_join.joined(frame(spark, data)), *NAMES) == plain(data)


def test_many_copies_and_empty(spark):
    data = made(2, 60) + [(500 + i, "a group of equal texts that is large") for i in range(200)]
    assert got(jaccard_join.joined(frame(spark, data).repartition(6)), *NAMES) == plain(data)
    assert jaccard_join.joined(frame(spark, [])).count() == 0


def test_signatures_of_similar_sets_meet():
    pick = random.Random(3)
    for _ in range(300):
        size = pick.choice([1, 2, 4, 7, 20, 60, 130, 300, 900])
        base = [pick.getrandbits(63) for _ in range(size)]
        other = list(base)
        for _ in range(pick.randrange(size // 4 + 1)):
            if pick.random() < 0.5 and len(other) > 1:
                other.pop(pick.randrange(len(other)))
            else:
                other.append(pick.getrandbits(63))
        both = len(set(base) & set(other))
        values = np.array(sorted(base) + sorted(other), np.uint64)
        rank = (values % np.uint64(3)).astype(np.uint8)
        found = [set(), set()]
        for text, token in jaccard_join.signatures(values, np.array([0, len(base), len(values)]), rank):
            for t, k in zip(text.tolist(), token.tolist()):
                found[t].add(k)
        if 4 * both >= 3 * len(set(base) | set(other)):
            assert found[0] & found[1]


def test_stage_keeps_one(spark):
    data = made(4, 60) + [(None, "alone and without a name, yes"), (901, None), (902, None)]
    docs = frame(spark, data)
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {c if n else i for i, n, c in plain(data) if i is not None}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300)]
    found = components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 200, 300)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_stages(spark):
    data = made(5, 40)
    context, group = spark.sparkContext, "stages of the join"
    context.setJobGroup(group, group)
    try:
        assert got(jaccard_join.joined(frame(spark, data)), *NAMES) == plain(data)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    run = sum(info.numCompletedTasks > 0 for info in map(tracker.getStageInfo, stages) if info)
    assert run < 125  # 150 before components and broadcasts took fewer shuffles, 103 after
