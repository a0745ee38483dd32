from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from framewitness.llm import suffix_dedup
from tests.llm.edge import frame, got, rows

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(data, window):
    big, least = float("inf"), {}
    for i, t in data:
        b, key = (t or "").encode(), big if i is None else i
        for s in range(len(b) - window + 1):
            g = b[s : s + window]
            least[g] = min(key, least.get(g, big))
    out = []
    for i, t in data:
        b, key = (t or "").encode(), big if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            if least[b[s : s + window]] < key:
                gone[s : s + window] = True
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, alphabet="abcdé ", size=150):
    pick = random.Random(seed)
    pool = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(40, size))) for _ in range(8)]
    data = []
    for i in range(150):
        text = "".join(pick.choice(pool) if pick.random() < 0.6 else "".join(pick.choice(alphabet) for _ in range(pick.randrange(60))) for _ in range(4))
        if pick.random() < 0.5 and text:
            k = pick.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        data.append((i % 140, text))
    return data


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_strings_are_removed(spark, hot):
    data = rows() + [(i + 1_000, t) for i, t in made(1)]
    found = suffix_dedup.deduped(frame(spark, data).repartition(5), hot=hot)
    assert got(found, *NAMES) == plain(data, suffix_dedup.WINDOW)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found.collect())


def test_short_windows_and_pieces(spark, monkeypatch):
    data = made(2, "ab", 60) + rows()[:9]
    found = suffix_dedup.deduped(frame(spark, data), window=9, gram=4)
    assert got(found, *NAMES) == plain(data, 9)


def test_pieces_share_their_ends():
    buffer = np.arange(100, dtype=np.uint8)
    whole = list(suffix_dedup._pieces(buffer, np.array([0, 100]), 50))
    assert len(whole) == 1
    old, suffix_dedup.PIECE = suffix_dedup.PIECE, 20
    try:
        cut = list(suffix_dedup._pieces(buffer, np.array([0, 100]), 50))
    finally:
        suffix_dedup.PIECE = old
    starts = [s + k for s, piece, _ in cut for k in range(len(piece) - 49)]
    assert starts == list(range(51))


def test_hot_and_empty(spark):
    data = [(i, "%d lead " % i + "the same long passage of all documents, which is hot " * 2) for i in range(300)]
    found = suffix_dedup.digests(frame(spark, data).repartition(7))
    assert got(found, *NAMES) == plain(data, suffix_dedup.WINDOW)
    assert suffix_dedup.digests(frame(spark, [])).count() == 0


def test_index_against_all_pairs():
    pick = random.Random(5)
    for _ in range(60):
        texts = list({bytes(pick.choice(b"ab") for _ in range(pick.randrange(6, 20))) for _ in range(pick.randrange(1, 12))})
        ids = np.array([pick.randrange(6) for _ in texts])
        least = {}
        for t, i in zip(texts, ids):
            for k in range(len(t) - 5):
                least[t[k : k + 6]] = min(i, least.get(t[k : k + 6], 99))
        for t, i, offsets in zip(texts, ids, suffix_dedup.marked(texts, ids, 6)):
            assert offsets.tolist() == [k for k in range(len(t) - 5) if least[t[k : k + 6]] < i]


def test_index_of_long_matches():
    pick = random.Random(7)
    base = [bytes(pick.choice(b"abcdefgh") for _ in range(60)) for _ in range(4)]
    texts = list({(pick.choice(base) + pick.choice(base))[pick.randrange(9) :] for _ in range(30)})
    ids = np.array([pick.randrange(6) for _ in texts])
    least = {}
    for t, i in zip(texts, ids):
        for k in range(len(t) - 5):
            least[t[k : k + 6]] = min(i, least.get(t[k : k + 6], 99))
    for t, i, offsets in zip(texts, ids, suffix_dedup.marked(texts, ids, 6)):
        assert offsets.tolist() == [k for k in range(len(t) - 5) if least[t[k : k + 6]] < i]


def test_suffixes_are_sorted_by_many_values_at_once(monkeypatch):
    pick = random.Random(8)
    passage = bytes(pick.choice(b"abcdefghijklmnop ") for _ in range(80))
    texts = [passage[:k] + b"!" + passage[k + 1 :] for k in range(0, 80, 2)]
    text = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), k) for k, t in enumerate(texts)])
    plain_order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    sizes, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **more: sizes.append(len(x)) or real(x, **more))
    assert suffix_dedup.suffix_order(text).tolist() == plain_order
    assert len(sizes) <= 5
