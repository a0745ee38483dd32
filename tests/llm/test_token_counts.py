from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewitness.llm import token_counts
from tests.llm.edge import frame, got, rows

NAMES = ("doc_id", "n_bytes", "n_tokens", "over_limit")


def plain(data, limit=token_counts.LIMIT):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in data]
    return sorted(((i, len((t or "").encode()), n, n > limit) for (i, t), n in zip(data, counts)), key=repr)


def test_counts_are_the_librarys(spark):
    pick = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "'", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", "d", "a", "B", "1", "22", "!", "é", "中", "　", "\xa0", "😀", "<|endoftext|>", "the", " and", "\x85", "٣"]
    made = [(5_000 + i, "".join(pick.choice(pieces) for _ in range(pick.randrange(60)))) for i in range(3_000)]
    data = rows() + made
    assert got(token_counts.token_counts(frame(spark, data)), *NAMES) == plain(data)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_chunks_compose():
    pick = np.random.default_rng(2)
    classes = pick.integers(0, 11, 3_000).astype(np.uint8)
    whole = token_counts.match_starts(classes)
    old = token_counts.CHUNK
    try:
        for size in (1, 7, 64):
            token_counts.CHUNK = size
            assert (token_counts.match_starts(classes) == whole).all()
    finally:
        token_counts.CHUNK = old


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 1 << 9)
    counter = token_counts.Counter()
    words = [f" w{i * 7919 % 10_007}ord" for i in range(400)]
    buffer = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.append(0, ends[:-1])
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    pieces = ["".join(words)[a:b] for a, b in zip(starts, ends)]
    want = [len(library.model.tokenize(p.replace(" ", "Ġ"))) for p in pieces]
    assert counter.count(buffer, starts, ends).tolist() == want
