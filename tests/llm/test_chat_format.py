from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from framewitness.llm import chat_format
from tests.oracle_check import normalised

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[:]", "[/ROLE]"]
BITS = [*CONTROL, "\\", "\\\\", "<", "[", "[INST] ", " [/INST]", "</s", "/s>", "\n<</SYS>>\n", "]", ">", "x", " ", "é😀",
        "[\\INST]", "<\\s>", "$1", "[\\\\:]", "s>", "<<SYS>>\n"]


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(seed: int = 3, many: int = 120):
    draw = random.Random(seed)
    out = []
    for conv in range(many):
        for turn in range(draw.randint(1, 6)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "[:]", "a[/ROLE]b", "x[", "User"])
            text = None if draw.random() < 0.05 else "".join(draw.choices(BITS, k=draw.randint(0, 8)))
            out.append((conv if conv != 4 else None, draw.choice([turn, turn, turn, turn + 600, None]), role, text))
    out += out[:5] + [(500, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 50) for i in range(700)]
    out.append((501, 0, "assistant", "long <s> text " * 20_000))
    draw.shuffle(out)
    return out


def plain(data):
    groups = defaultdict(list)
    both = "</s>[INST] ok [/INST]"
    for conv, turn, role, text in [*data, (-1, 0, "user", both), (-1, 1, "assistant", both)]:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.append((conv, len(turns), hashed(lines), len(loss), hashed(loss)))
    return sorted(out, key=repr)


NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_digests_and_sql(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA + ", block int, formatted string")
    digests = chat_format.digests(df)
    found = [tuple(r) for r in digests.collect()]
    assert sorted((r[:5] for r in found), key=repr) == plain(data)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    cursor = con.execute(chat_format.ORACLE)
    assert normalised([d[0] for d in cursor.description], cursor.fetchall()) == normalised(digests.columns, found)


def test_texts_hold_no_bare_control_strings(spark):
    data = [(i, 0, "assistant", f"a {mark} b {mark[0]}\\{mark[1:]}") for i, mark in enumerate(CONTROL)]
    for row in chat_format.formatted(spark.createDataFrame(data, SCHEMA)).collect():
        inside = row.formatted[3:-4]
        assert not any(mark in inside for mark in CONTROL)
        assert [(s.start, s.stop) for s in row.loss_spans] == [(3, len(row.formatted) - 4)]


def test_plain_texts_stay_as_they_are(spark):
    data = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"), (1, 300, "tool", "{}")]
    blocks = sorted(chat_format.formatted(spark.createDataFrame(data, SCHEMA)).collect(), key=lambda r: r.block)
    assert "".join(b.formatted for b in blocks) == (
        "<<SYS>>\nBe brief.\n<</SYS>>\n[INST] Hi [/INST]<s>Hello</s>[ROLE]tool[:]{}[/ROLE]"
    )
    assert [b.block for b in blocks] == [0, 1]


def test_empty_table(spark):
    found = chat_format.digests(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.conv_id for r in found] == [-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_escape_is_reversible(spark, seed):
    draw = random.Random(seed)
    texts = [("".join(draw.choices(BITS, k=draw.randint(0, 12))),) for _ in range(3_000)]
    df = spark.createDataFrame(texts, "text string")
    again = chat_format.unescaped(chat_format.escaped(df["text"]))
    assert df.where(again != df["text"]).count() == 0
    assert df.where(chat_format.escaped(df["text"]).rlike(chat_format._BARE)).count() == 0
