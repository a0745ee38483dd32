from __future__ import annotations

import hashlib
import random

import pytest

from framewitness.llm import substring_dedup
from tests.llm.edge import frame, got, rows, words

NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def plain(data, window):
    least = {}
    big = float("inf")
    for i, t in data:
        w, key = words(t), big if i is None else i
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            least[g] = min(key, least.get(g, big))
    out = []
    for i, t in data:
        w, key = words(t), big if i is None else i
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < key:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    pick = random.Random(seed)
    pool = [" ".join(pick.choice("ab cd ef gh ij é".split()) + str(pick.randrange(40)) for _ in range(pick.randrange(30, 140))) for _ in range(6)]
    data = []
    for i in range(120):
        pieces = [pick.choice(pool) if pick.random() < 0.5 else " ".join(str(pick.randrange(9999)) for _ in range(pick.randrange(60))) for _ in range(3)]
        text = pick.choice([" ", "\n", " \t "]).join(pieces).split(" ")
        if pick.random() < 0.4 and text:
            text[pick.randrange(len(text))] = "edited"
        data.append((i % 110, " ".join(text)))
    return data


@pytest.mark.parametrize("cells", [None, 256])
def test_windows_are_removed(spark, cells):
    data = rows() + [(i + 1_000, t) for i, t in made(1)]
    docs = frame(spark, data).repartition(5)
    found = substring_dedup.deduped(docs, cells=cells)
    assert got(found, *NAMES) == plain(data, substring_dedup.WINDOW)
    kept = {(r.doc_id, r.n_removed): r.kept_text for r in found.collect()}
    assert kept[(4, 0)] == "one" and kept[(10, 60)] == "lead"


def test_short_windows(spark):
    data = made(2) + rows()[:7]
    found = substring_dedup.deduped(frame(spark, data), window=6, gram=3)
    assert got(found, *NAMES) == plain(data, 6)


def test_hot_windows_and_empty(spark):
    data = [(i, "lead%d " % i + " ".join(f"w{k}" for k in range(80))) for i in range(300)]
    found = substring_dedup.digests(frame(spark, data).repartition(7))
    assert got(found, *NAMES) == plain(data, substring_dedup.WINDOW)
    assert substring_dedup.digests(frame(spark, [])).count() == 0
