from __future__ import annotations

import random

from framewitness.llm import decontaminate
from tests.llm.edge import frame, got, rows, words

_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def plain_words(text):
    out = []
    for w in words((text or "").translate({c: c + 32 for c in range(65, 91)})):
        for _ in range(4):
            w = w[1:] if len(w) > 1 and w[0] in _MARKS else w
            w = w[:-1] if len(w) > 1 and w[-1] in _MARKS else w
        out.append(w)
    return out


def plain(docs, items):
    """All items laid on all documents at all shifts on which some seed agrees."""
    found = {}
    for i, t in docs:
        w = plain_words(t)
        for j, u in items:
            v = plain_words(u)
            if len(v) < decontaminate.SHORTEST:
                continue
            for shift in range(-len(v) + 1, len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                if len(v) >= decontaminate.SPAN:
                    hit = any(all(p + q < len(v) and same[p + q] for q in m) for m in decontaminate.MASKS for p in range(len(v)))
                else:
                    hit = all(same)
                if not hit:
                    continue
                best = (0, 0)
                for a in range(len(v)):
                    for b in range(a + 1, len(v) + 1):
                        inside = same[a:b]
                        if not all(0 <= shift + k < len(w) for k in range(a, b)):
                            continue
                        best = max(best, (sum(inside) - decontaminate.PENALTY * (len(inside) - sum(inside)), sum(inside)))
                needed = min(13, -(-3 * len(v) // 4)) if len(v) >= decontaminate.SPAN else len(v)
                if best[1] >= needed:
                    found[(i, j)] = max(best[1], found.get((i, j), 0))
    return sorted(((i, j, n) for (i, j), n in found.items()), key=repr)


def test_leaks_are_found_and_clean_rows_left(spark):
    pick = random.Random(1)
    vocabulary = [f"word{i}" for i in range(4_000)]
    items = [(k, " ".join(pick.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 4, 5, 8, 11, 12, 14, 20, 35, 59])]
    items += [(50, None), (51, ""), (None, " ".join(f"nil{i}" for i in range(20))), (7, items[7][1])]
    data = [(i, t) for i, t in rows() if len(t or "") < 2_000]
    for k in range(80):
        j, text = pick.choice(items)
        v = (text or "").split()
        for _ in range(pick.choice([0, 0, 1, 2, 5])):
            if v:
                v[pick.randrange(len(v))] = pick.choice(vocabulary)
        lead = [pick.choice(vocabulary) for _ in range(pick.randrange(30))]
        tail = [pick.choice(vocabulary) for _ in range(pick.randrange(30))]
        data.append((100 + k, pick.choice([" ", "\n", ", "]).join(lead + [w.upper() for w in v] + tail)))
    items_frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, shift string")
    found = decontaminate.leaks(frame(spark, data), items_frame)
    assert got(found, "doc_id", "item_id", "matching") == plain(data, items)
    assert found.count() > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, rows()), none).count() == 0
    assert decontaminate.leaks(frame(spark, []), none).count() == 0


def test_stage(spark, tmp_path):
    items = [(1, " ".join(f"test{i}" for i in range(20)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows() + [(70, "before " + items[0][1].upper() + " after")])
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted(docs.where("doc_id IS NULL OR doc_id <> 70").collect(), key=repr)
