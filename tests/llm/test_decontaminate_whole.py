from __future__ import annotations

import random
from itertools import combinations

from framewitness.llm import decontaminate
from tests.llm.edge import frame, got
from tests.llm.test_decontaminate import plain_words


def plain(docs, items):
    """All items on all documents at all shifts, without any seeds."""
    found = {}
    for i, t in docs:
        w = plain_words(t)
        for j, u in items:
            v = plain_words(u)
            for shift in range(-len(v) + 1, len(w)) if len(v) >= 5 else ():
                same = [w[shift + k] == v[k] for k in range(len(v)) if 0 <= shift + k < len(w)]
                if not any(same):
                    continue
                best = (0, 0)
                for a in range(len(same)):
                    good = 0
                    for b in range(a, len(same)):
                        good += same[b]
                        best = max(best, (good - decontaminate.PENALTY * (b + 1 - a - good), good))
                needed = min(13, -(-3 * len(v) // 4)) if len(v) >= 12 else len(v)
                n = best[1] if best[1] >= needed else sum(same) if 4 * sum(same) >= 3 * len(v) else 0
                if n:
                    found[(i, j)] = max(n, found.get((i, j), 0))
    return sorted(((i, j, n) for (i, j), n in found.items()), key=repr)


def test_a_quarter_of_changed_words_hides_no_item(spark):
    pick = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3_000)]
    items = [(n, " ".join(pick.choice(vocabulary) for _ in range(n))) for n in (4, 5, 6, 8, 10, 11, 12, 15, 16, 18, 20, 27, 40, 59)]
    data = []
    for k in range(150):
        n, text = pick.choice(items)
        v = text.split()
        for at in pick.sample(range(n), pick.choice([n // 4, n // 4, n // 4 + 1, 1, n // 2])):
            v[at] = pick.choice(vocabulary)
        cut = pick.choice([0, 0, 0, 2])
        lead = [pick.choice(vocabulary) for _ in range(0 if cut else pick.randrange(30))]
        tail = [pick.choice(vocabulary) for _ in range(pick.randrange(30))]
        data.append((k, " ".join(lead + v[cut:] + tail)))
    found = decontaminate.leaks(frame(spark, data), spark.createDataFrame(items, "item_id long, text string"), whole=True)
    assert got(found, "doc_id", "item_id", "matching") == plain(data, items)
    assert found.count() > 50


def test_masks_see_every_pattern():
    for n in (5, 8, 12, 16):
        for changed in combinations(range(n), n // 4):
            kept = set(range(n)) - set(changed)
            masks = decontaminate.CLOSE_MASKS
            assert any(kept.issuperset(p + q for q in m) for m in masks for p in range(n - max(m)))
