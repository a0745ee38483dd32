from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import pytest

from framewitness.llm import conversation_repair as repair
from tests.oracle_check import normalised

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed: int = 5, many: int = 150, longest: int = 9):
    """Random dialogues, some with nulls, ties, repeats, gaps, odd roles and blanks."""
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "Why? ", "ok.\n", "  ", "", None, "A. ", "long " * 50 + "end!", "Ünïcode."]
    rows = []
    for conv in range(many):
        turns = draw.randint(1, longest)
        for turn in range(turns):
            role = roles[turn % 2] if draw.random() < 0.6 else draw.choice(roles)
            text = f"Turn {turn} of {conv}." if draw.random() < 0.4 else draw.choice(texts)
            number = None if draw.random() < 0.05 else turn + draw.choice([0, 0, 0, 3])
            rows.append((conv if conv != 7 else None, number, role, text))
            if draw.random() < 0.05:
                rows.append(rows[-1])
    draw.shuffle(rows)
    return rows


def cheapest_edits(rows):
    """(cost, audit, repaired): all least costs of each state, spelled out as strings."""

    def written(state, role):
        if role[:1] == "s":
            return 1 if state == 0 else None
        if role[:1] == "u":
            return 2 if state != 2 else None
        return 3 if role[:1] == "a" and state == 2 else None

    def inserted(states):
        for _ in range(4):
            for state, ways in list(states.items()):
                for role in ("user", "assistant"):
                    after = written(state, role)
                    if after is not None:
                        states[after] |= {(c + 2, a + "I", o + ((role, ""),)) for c, a, o in ways}
            states = defaultdict(set, {s: {min(w)} for s, w in states.items() if w})
        return states

    states = defaultdict(set, {0: {(0, "", ())}})
    for role, text, kind in rows:
        after = defaultdict(set)
        for state, ways in inserted(states).items():
            for cost, audit, out in ways:
                after[state].add((cost + 3, audit + "D", out))
                if kind == "gone":
                    continue
                extra = kind == "truncated"
                for edit, paid, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    to = written(state, name)
                    if to is not None:
                        after[to].add((cost + paid + extra, audit + edit, out + ((name, text),)))
        states = after
    ends = inserted(states)
    return min(min(ends[s]) for s in (0, 3) if ends[s])


def plain(rows):
    """The contract's rows, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        group = groups[conv]
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        mark = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
        group += [((turn is not None, turn or 0, mark), turn, role, text)] * (draw != 0) * (2 if draw == 3 else 1)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda row: row[0])
        seen, kinds, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in group:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = (
                "blank" if not letters else "duplicate" if (role, text) in seen
                else "truncated" if letters[-1] not in ".!?" else None
            )
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds.append("gone" if fault in ("blank", "duplicate") else fault)
        turns = [turn for _, turn, _, _ in group if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, _, role, _ in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = cheapest_edits([(r, t, k) for (_, _, r, t), k in zip(group, kinds)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *count.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(row[n] for n in NAMES) for row in df.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 5, repair.BLOCK])
def test_digests(spark, block):
    rows = conversations()
    wide = [(*row, 1, "x") for row in rows]
    df = spark.createDataFrame(wide, SCHEMA + ", copies int, mark string")
    assert got(repair.digests(df, block=block)) == plain(rows)


def test_one_long_conversation(spark):
    rows = [(3, i, ("user", "assistant")[i % 3 == 1], f"Turn {i % 40}{'.' * (i % 5 > 0)}") for i in range(3_000)]
    rows += [(4, 0, "user", "Hello.")] * 50 + [(5, 1, "system", "Be brief.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.digests(df, block=100)) == plain(rows)


def test_empty_table_and_dropped_conversations(spark):
    assert repair.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone.")]
    found = got(repair.digests(spark.createDataFrame(rows, SCHEMA)))
    assert found == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == plain(rows)


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.createDataFrame(conversations(11), SCHEMA)
    found = repair.repair(df, block=3)
    turns = defaultdict(str)
    for row in sorted(found.blocks.collect(), key=lambda r: (repr(r.conv_id), r.part, r.block)):
        turns[row.conv_id] += "".join(turn.role[:1] for turn in row.turns)
    assert len(turns) == found.conversations.count() == 150
    assert all(re.fullmatch("(s?(ua)+)?", initials) for initials in turns.values())


def test_sql_agrees(spark):
    rows = conversations(8, 60, 7)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(repair.ORACLE)
    want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    assert want == normalised(list(NAMES), plain(rows))


@pytest.mark.parametrize("collide", [False, True])
def test_paths_in_order(collide):
    paths = repair.Paths()
    nodes = {"": 0}
    for length in range(1, 8):
        for word in map("".join, product("DK", repeat=length)):
            nodes[word] = paths.add(nodes[word[:-1]], word[-1])
    if collide:
        paths.hash = [7 if i % 3 else h for i, h in enumerate(paths.hash)]
    draw = random.Random(1)
    for _ in range(2_000):
        a, b = ("".join(draw.choices("DK", k=7)) for _ in range(2))
        if a != b:
            assert paths.before(nodes[a], nodes[b]) == (a < b)
            assert "".join(paths.labels(nodes[a])) == a
