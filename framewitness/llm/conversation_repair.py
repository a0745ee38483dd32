"""Conversation structure repair: the cheapest edits that make a dialogue well formed.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Turns may
be kept (0), given the role user or assistant (2), deleted (3) or preceded by a turn
inserted with an empty text (2); a blank or repeated turn must go, and a truncated one
that stays costs 1 more. Of equally cheap edits the ones whose initials come first in
ASCII are taken.

*Audit DP.* Four states follow the roles written so far. Each state's best edits are a
path of linked nodes, one for a turn, so that prefixes are shared. Each node knows its
ancestors 1, 2, 4, ... steps up and a rolling hash of its path. Two paths of equal cost
are compared where they first differ, which a search over the ancestors finds by their
hashes; that the nodes above it are one and the same is verified, and looked for by
identity if the hashes collided. A turn's label is what is inserted before it and its own
edit, so labels at one depth belong to one turn and none begins another.

*Scale.* Turns are range-partitioned by conversation and turn, so one conversation may
lie in many partitions, and read in order by blocks of at most ``BLOCK`` turns. A
conversation inside one block is solved there. The blocks of the others (two for each
partition, and the long ones) get their repeated turns from a grouped minimum, are solved
from each of the four states, and put together by the same DP over blocks, which sees
four by four costs and the order of the paths, no texts.

Defined results: nulls in role or text count as one space, a null conv_id is a
conversation of its own, null turns come first, turns of one number are in order of the
SHA-256 of role and text, repeated rows are turns of their own, other columns are left
out, an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.shared import parts, table, written

#: Turns of a block, and the bytes of text after which a block ends early.
BLOCK = 4_096
_BLOCK_BYTES = 16 << 20

RETYPE, DELETE, INSERT, CUT = 2, 3, 2, 1
_SPACE = " \t\n\x0b\f\r"

# Nothing written yet, a system turn, a user turn, an assistant turn.
_STATES = range(4)
_USER_NEXT, _ASSISTANT_NEXT = (0, 1, 3), (2,)
_FINE, _TRUNCATED, _GONE = range(3)


def _insertion(state: int) -> int:
    """The state after inserting the turn that a state calls for."""
    return 3 if state == 2 else 2


def _arcs(initial: str, kind: int) -> dict[int, list[tuple[int, int, str]]]:
    """For each state after a turn: (state before, cost, label) of the cheapest ways."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for start in _STATES:
        state = start
        for inserted in range(3):
            paid, label = INSERT * inserted, "I" * inserted
            ways = [(state, DELETE, "D")]
            if kind != _GONE:
                extra = CUT if kind == _TRUNCATED else 0
                after = _insertion(state)
                ways.append((after, RETYPE + extra, "R"))
                if initial == "s" and state == 0:
                    ways.append((1, extra, "K"))
                elif (initial == "u" and state in _USER_NEXT) or (initial == "a" and state in _ASSISTANT_NEXT):
                    ways.append((after, extra, "K"))
            for after, cost, edit in ways:
                way = (paid + cost, label + edit)
                found[start, after] = min(found.get((start, after), way), way)
            state = _insertion(state)
    arcs: dict[int, list[tuple[int, int, str]]] = {}
    for (start, after), (cost, label) in found.items():
        arcs.setdefault(after, []).append((start, cost, label))
    return arcs


_ARCS = {(initial, kind): _arcs(initial, kind) for initial in "sua " for kind in (_FINE, _TRUNCATED, _GONE)}
#: What has to be inserted in the end, and its cost.
_TAILS = {0: ("", 0), 1: ("II", 2 * INSERT), 2: ("I", INSERT), 3: ("", 0)}

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Paths:
    """Paths from one root, as nodes that share their prefixes."""

    def __init__(self):
        self.label = [None]
        self.above = [[]]
        self.hash = [1]

    def add(self, parent: int, label) -> int:
        above, step, at = [parent], 0, parent
        while step < len(self.above[at]):
            at = self.above[at][step]
            above.append(at)
            step += 1
        self.above.append(above)
        self.label.append(label)
        self.hash.append((self.hash[parent] * _BASE + hash(label)) % _PRIME)
        return len(self.label) - 1

    def _fork(self, a: int, b: int, key) -> tuple[int, int]:
        """The highest ancestors of two different nodes of one depth that differ in key."""
        for step in reversed(range(len(self.above[a]))):
            if step < len(self.above[a]):
                up, across = self.above[a][step], self.above[b][step]
                if key(up) != key(across):
                    a, b = up, across
        return a, b

    def before(self, a: int, b: int) -> bool:
        """Does the path of a come before that of b, another node of the same depth?"""
        one, other = self._fork(a, b, self.hash.__getitem__)
        if self.above[one][0] != self.above[other][0]:
            # Hashes of different prefixes are the same: look for the nodes themselves.
            one, other = self._fork(a, b, lambda node: node)
        return self.label[one] < self.label[other]

    def labels(self, node: int) -> list:
        found = []
        while node:
            found.append(self.label[node])
            node = self.above[node][0]
        return found[::-1]


def cheapest(steps, start: int = 0) -> tuple[Paths, dict[int, tuple[int, int]]]:
    """Best (cost, node) for each state that can be reached through all steps.

    A step maps each state after it to its (state before, cost, label) ways.
    """
    paths = Paths()
    now = {start: (0, 0)}
    for arcs in steps:
        after = {}
        for state, ways in arcs.items():
            best = None
            for source, cost, label in ways:
                if source in now:
                    paid, node = now[source]
                    paid += cost
                    if best is None or paid < best[0] or (paid == best[0] and paths.before(node, best[1])):
                        best = (paid, node, label)
            if best is not None:
                after[state] = (best[0], paths.add(best[1], best[2]))
        now = after
    return paths, now


def ended(paths: Paths, states: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, state, node) of the best path with what must be inserted in the end."""
    best = None
    for state, (cost, node) in states.items():
        cost += _TAILS[state][1]
        if best is None or cost < best[0] or (cost == best[0] and paths.before(node, best[2])):
            best = (cost, state, node)
    return best


def applied(labels, initials, start: int = 0) -> tuple[list[int], list[int]]:
    """The turns (their place, -1 if inserted) that remain, and the role that each is
    given: 0 its own, 1 user, 2 assistant. ``labels`` may end with a label that has
    insertions only; ``initials`` are those of the roles before."""
    places, roles, state = [], [], start
    for at, label in enumerate(labels):
        for edit in label:
            if edit == "D":
                continue
            if edit == "K":
                places.append(at)
                roles.append(0)
            else:
                places.append(-1 if edit == "I" else at)
                roles.append(2 if state == 2 else 1)
            system = edit == "K" and state == 0 and initials[at] == "s"
            state = 1 if system else _insertion(state)
    return places, roles


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_RAW = "array<struct<role string, text string, mark binary, initial string, kind int>>"
_COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal")
_FACTS = (
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()),
    ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least_turn", pa.int64()),
    ("most_turn", pa.int64()), ("turn_numbers", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
)
_TURNS = "array<struct<role string, text string>>"


def _ddl(fields) -> str:
    spark = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{name} {spark[kind]}" for name, kind in fields)


def _repaired_turns(role, text, places, roles, offsets):
    """Arrow list of the turns at places; inserted ones have an empty text."""
    at = pa.array(places, pa.int32())
    at = pc.if_else(pc.less(at, 0), pa.scalar(None, pa.int32()), at)
    given = pc.if_else(
        pc.equal(pa.array(roles, pa.int8()), 0),
        role.take(at),
        pc.if_else(pc.equal(pa.array(roles, pa.int8()), 1), "user", "assistant"),
    )
    turns = pa.StructArray.from_arrays([given, pc.fill_null(text.take(at), "")], fields=list(_TURN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), turns)


class _Blocks:
    """Reads the sorted turns of a partition and solves its conversations."""

    def __init__(self, part: int, block: int):
        self.part, self.limit = part, block
        self.number = 0
        # Can the conversation at hand have begun in the partition before, or above?
        self.open = True

    def over(self, batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            out, kept = self._solved(rows.combine_chunks(), last=False)
            if out is not None:
                yield out
            rest = rows.slice(kept)
        if rest is not None and rest.num_rows:
            out, _ = self._solved(rest.combine_chunks(), last=True)
            yield out

    def _solved(self, rows, last: bool):
        """Solve what ends in these rows; the rest begins at the returned row."""
        columns = {n: rows.column(n).to_pylist() for n in ("conv_id", "turn", "copies", "initial", "kind", "mark")}
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(rows.column("text")).cast(pa.int64()), 0)).to_numpy()
        conv, copies = columns["conv_id"], columns["copies"]
        ends, begin, turns = [], 0, 0
        for at in range(len(conv)):
            if at > begin and conv[at] != conv[begin]:
                ends.append((begin, at, True))
                begin, turns = at, 0
            turns += max(1, copies[at])
            if turns >= self.limit or size[at] - size[begin] > _BLOCK_BYTES:
                ends.append((begin, at + 1, False))
                begin, turns = at + 1, 0
        if last and begin < len(conv):
            ends.append((begin, len(conv), False))
            begin = len(conv)
        # A block cut right where its conversation ends leaves nothing behind.
        if not ends:
            return None, 0
        return self._block_rows(rows, columns, ends), begin

    def _block_rows(self, rows, columns, ends):
        conv = columns["conv_id"]
        out = {name: [] for name, _ in _FACTS}
        places, roles, offsets = [], [], [0]
        raw_at, raw_kind, raw_copy, raw_offsets = [], [], [], [0]
        for position, (begin, end, complete) in enumerate(ends):
            if position and conv[begin] != conv[ends[position - 1][0]]:
                self.open = False
            whole = complete and not self.open
            # A block that did not end with its conversation leaves the next one open.
            self.open = not complete
            facts, kinds, at = _facts(columns, begin, end, whole)
            out["conv_id"].append(conv[begin])
            out["part"].append(self.part)
            out["block"].append(self.number)
            out["whole"].append(whole)
            self.number += 1
            for name, value in facts.items():
                out[name].append(value)
            cost = audit = None
            if whole:
                initial = columns["initial"]
                paths, states = cheapest([_ARCS[initial[i], k] for i, k in zip(at, kinds)])
                cost, state, node = ended(paths, states)
                labels = paths.labels(node) + [_TAILS[state][0]]
                audit = "".join(labels)
                where, given = applied(labels, [initial[i] for i in at])
                places += [at[i] if i >= 0 else -1 for i in where]
                roles += given
            else:
                raw_at += at
                raw_kind += kinds
                raw_copy += [i > 0 and at[i] == at[i - 1] for i in range(len(at))]
            out["cost"].append(cost)
            out["audit"].append(audit)
            offsets.append(len(places))
            raw_offsets.append(len(raw_at))
        column = {n: rows.column(n).combine_chunks() for n in ("role", "text", "mark", "initial")}
        turns = _repaired_turns(column["role"], column["text"], places, roles, offsets)
        take = pa.array(raw_at, pa.int32())
        # A copy of a turn goes in any case, so its text is not carried.
        text = pc.if_else(pa.array(raw_copy, pa.bool_()), pa.scalar(None, pa.string()), column["text"].take(take))
        raw = pa.StructArray.from_arrays(
            [column["role"].take(take), text, column["mark"].take(take), column["initial"].take(take),
             pa.array(raw_kind, pa.int32())],
            names=["role", "text", "mark", "initial", "kind"],
        )
        raw = pa.ListArray.from_arrays(pa.array(raw_offsets, pa.int32()), raw)
        arrays = [pa.array(out[name], kind) for name, kind in _FACTS]
        return pa.RecordBatch.from_arrays([*arrays, turns, raw], names=[*out, "turns", "raw"])


def _facts(columns, begin, end, whole):
    """Counts of a block, and its turns: kinds and rows, copies spelled out.

    In a whole conversation repeated turns are found here; elsewhere they are not known
    yet, and neither is what they hide.
    """
    kinds, at, seen = [], [], set()
    counts = dict.fromkeys(_COUNTS, 0)
    initial, pairs = columns["initial"], ("su", "ua", "au")
    before = None
    for row in range(begin, end):
        for copy in range(columns["copies"][row]):
            kind = columns["kind"][row]
            if kind == _GONE:
                counts["blank"] += 1
            elif whole and columns["mark"][row] in seen:
                kind = _GONE
                counts["duplicate"] += 1
            elif whole:
                seen.add(columns["mark"][row])
                counts["truncated"] += kind == _TRUNCATED
            if before is not None and before + initial[row] not in pairs:
                counts["illegal"] += 1
            before = initial[row]
            kinds.append(kind)
            at.append(row)
    counts["n_turns"] = len(at)
    numbers = [columns["turn"][row] for row in dict.fromkeys(at) if columns["turn"][row] is not None]
    facts = counts | {
        "first": initial[at[0]] if at else None,
        "last": before,
        "least_turn": numbers[0] if numbers else None,
        "most_turn": numbers[-1] if numbers else None,
        "turn_numbers": len(set(numbers)),
    }
    return facts, kinds, at


_PATHS = "array<struct<start int, state int, cost long, place int, audit string>>"


def _block_paths(batches):
    """Solve each open block from each state, with its repeated turns now known."""
    names = ["conv_id", "part", "block", "duplicate", "truncated", "paths"]
    fields = [("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()),
              ("audit", pa.string())]
    for batch in batches:
        out = {n: [] for n in names}
        columns = {n: batch.column(n).to_pylist() for n in ("conv_id", "part", "block", "firsts")}
        raw = batch.column("raw")
        for row in range(batch.num_rows):
            turns = raw[row].values
            kinds = turns.field("kind").to_pylist() if turns is not None else []
            initial = turns.field("initial").to_pylist() if turns is not None else []
            firsts = set(columns["firsts"][row] or ())
            repeated = [k != _GONE and i not in firsts for i, k in enumerate(kinds)]
            kinds = [_GONE if again else kind for kind, again in zip(kinds, repeated)]
            steps = [_ARCS[letter, kind] for letter, kind in zip(initial, kinds)]
            found = []
            for start in _STATES:
                paths, states = cheapest(steps, start)
                ways = [("".join(paths.labels(node)), state, cost) for state, (cost, node) in states.items()]
                found += [
                    {"start": start, "state": state, "cost": cost, "place": place, "audit": audit}
                    for place, (audit, state, cost) in enumerate(sorted(ways))
                ]
            for name in ("conv_id", "part", "block"):
                out[name].append(columns[name][row])
            out["duplicate"].append(sum(repeated))
            out["truncated"].append(kinds.count(_TRUNCATED))
            out["paths"].append(found)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct(fields))]
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)


_CHOICE = (
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("final", pa.bool_()),
    ("start", pa.int32()), ("state", pa.int32()), ("tail", pa.string()), ("cost", pa.int64()),
    ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("least_turn", pa.int64()), ("most_turn", pa.int64()), ("turn_numbers", pa.int64()),
)


def _conversations(batches):
    """Rows of one conversation after the other, as lists of dicts, from sorted batches."""
    conv, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["conv_id"] != conv:
                yield rows
                rows = []
            conv = row["conv_id"]
            rows.append(row)
    if rows:
        yield rows


def _chosen(batches):
    """The path of each block in the best repair of its conversation, and its totals."""
    schema = pa.schema(_CHOICE)
    for rows in _conversations(batches):
        steps = []
        for row in rows:
            arcs = {}
            for way in row["paths"]:
                label = (way["place"], way["state"])
                arcs.setdefault(way["state"], []).append((way["start"], way["cost"], label))
            steps.append(arcs)
        paths, states = cheapest(steps)
        cost, state, node = ended(paths, states)
        totals = {name: sum(row[name] for row in rows) for name in _COUNTS}
        numbers = sum(row["turn_numbers"] for row in rows)
        letter = most = None
        for row in rows:
            if row["n_turns"]:
                totals["illegal"] += letter is not None and letter + row["first"] not in ("su", "ua", "au")
                letter = row["last"]
            if row["turn_numbers"]:
                numbers -= most == row["least_turn"]
                most = row["most_turn"]
        least = [row["least_turn"] for row in rows if row["turn_numbers"]]
        out, start = [], 0
        for row, (_, after) in zip(rows, paths.labels(node)):
            out.append({n: row[n] for n in ("conv_id", "part", "block")} | {"start": start, "state": after})
            start = after
        out[-1] |= totals | {
            "final": True, "tail": _TAILS[state][0], "cost": cost, "turn_numbers": numbers,
            "least_turn": least[0] if least else None, "most_turn": most,
        }
        for begin in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[begin : begin + 10_000], schema)


def _edited(batches):
    """Apply the chosen audits to open blocks."""
    for batch in batches:
        raw = batch.column("raw")
        turns = raw.flatten()
        initials = turns.field("initial").to_pylist()
        starts, audits, tails = (batch.column(n).to_pylist() for n in ("start", "audit", "tail"))
        lengths = pc.fill_null(pc.list_value_length(raw), 0).to_pylist()
        places, roles, offsets, base, whole = [], [], [0], 0, []
        for start, audit, tail, length in zip(starts, audits, tails, lengths):
            labels = _labels(audit) + [tail or ""]
            where, given = applied(labels, initials[base : base + length], start)
            places += [base + i if i >= 0 else -1 for i in where]
            roles += given
            offsets.append(len(places))
            base += length
            whole.append(audit + (tail or ""))
        repaired = _repaired_turns(turns.field("role"), turns.field("text"), places, roles, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), batch.column("block"), pa.array(whole, pa.string()), repaired],
            names=["conv_id", "part", "block", "audit", "turns"],
        )


def _labels(audit: str) -> list[str]:
    """The audit cut behind each edit of a turn."""
    labels, begin = [], 0
    for at, edit in enumerate(audit):
        if edit != "I":
            labels.append(audit[begin : at + 1])
            begin = at + 1
    return labels


class Repair(NamedTuple):
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    ``blocks``: conv_id, part, block, alone, audit and the repaired ``turns`` (role, text)
    of up to ``BLOCK`` turns; by part and block they follow one another, and ``alone``
    marks the only one of its conversation."""

    conversations: DataFrame
    blocks: DataFrame


def _faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, and what the repair looks at."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.col("copies").cast("int").alias("copies"),
    )
    kept = F.rtrim("text", F.lit(_SPACE))
    letter = F.substring("role", 1, 1)
    kind = F.when(kept == "", _GONE).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), _FINE).otherwise(_TRUNCATED)
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256))
    return rows.select(
        "*",
        kind.cast("int").alias("kind"),
        F.when(letter.isin("s", "u", "a"), letter).otherwise(" ").alias("initial"),
        mark.alias("mark"),
    )


def _only(column: str, *fields: str):
    """An array of structs with some of their fields."""
    return F.transform(column, lambda one: F.struct(*(one[f].alias(f) for f in fields))).alias(column)


def repair(turns: DataFrame, *, block: int = BLOCK) -> Repair:
    """Repair all conversations of (conv_id, turn, role, text).

    A column ``copies``, if there is one, says how often a row stands; a row with none
    keeps its conversation in the result.
    """
    spark = turns.sparkSession
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    order = ["conv_id", "turn", "mark", "salt"]
    # Rows that agree in all the rest may lie anywhere among themselves.
    rows = _faults(turns.select("conv_id", "turn", "role", "text", "copies")).withColumn("salt", F.spark_partition_id())
    ranged = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).drop("salt")

    def solve(batches):
        yield from _Blocks(TaskContext.get().partitionId(), block).over(batches)

    first = written(ranged.mapInArrow(solve, f"{_ddl(_FACTS)}, turns {_TURNS}, raw {_RAW}"), "repair-blocks")
    open_blocks = first.where("NOT whole")
    marks = open_blocks.select("conv_id", "part", "block", F.posexplode("raw").alias("place", "turn")).where(
        F.col("turn.kind") != _GONE
    )
    firsts = (
        marks.groupBy("conv_id", F.col("turn.mark").alias("mark"))
        .agg(F.min(F.struct("part", "block", "place")).alias("at"))
        .groupBy("at.part", "at.block")
        .agg(F.collect_list("at.place").alias("firsts"))
    )
    solved = written(
        open_blocks.select("conv_id", "part", "block", "raw")
        .join(firsts, ["part", "block"], "left")
        .select("conv_id", "part", "block", _only("raw", "initial", "kind"), "firsts")
        .mapInArrow(_block_paths, f"conv_id long, part int, block int, duplicate long, truncated long, paths {_PATHS}"),
        "repair-paths",
    )
    narrow = open_blocks.select(
        "part", "block", "n_turns", "blank", "illegal", "first", "last", "least_turn", "most_turn", "turn_numbers"
    ).join(
        solved.withColumn("paths", _only("paths", "start", "state", "cost", "place")),
        ["part", "block"],
    )
    choices = written(
        narrow.repartition(parts(spark), "conv_id")
        .sortWithinPartitions("conv_id", "part", "block")
        .mapInArrow(_chosen, _ddl(_CHOICE)),
        "repair-choices",
    )
    path = F.filter("paths", lambda p: (p["start"] == F.col("start")) & (p["state"] == F.col("state")))[0]
    edited = (
        open_blocks.select("conv_id", "part", "block", "raw")
        .join(choices.select("part", "block", "start", "state", "tail"), ["part", "block"])
        .join(solved.select("part", "block", "paths"), ["part", "block"])
        .select("conv_id", "part", "block", "raw", "start", path["audit"].alias("audit"), "tail")
        .mapInArrow(_edited, f"conv_id long, part int, block int, audit string, turns {_TURNS}")
    )
    blocks = (
        first.where("whole")
        .select("conv_id", "part", "block", F.lit(True).alias("alone"), "audit", "turns")
        .unionByName(edited.withColumn("alone", F.lit(False)))
    )
    span = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turn_numbers"), F.lit(0))
    totals = ["conv_id", span.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"]
    conversations = first.where("whole").select(*totals).unionByName(choices.where("final").select(*totals))
    return Repair(conversations, blocks)


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that the query plants: a turn in five by the crc32 of ``conv_id:turn``."""
    spaced = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    draw = F.pmod(F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])), F.lit(20))
    return conversations.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), draw.alias("draw")).select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"),
    )


def _streamed_digests(batches):
    """Audit and hash of conversations in several blocks, turn by turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv = digest = None
    audits = []

    def done():
        row = {"conv_id": conv, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for row in range(batch.num_rows):
            here = batch.column("conv_id")[row].as_py()
            if digest is None or here != conv:
                if digest is not None:
                    yield done()
                conv, digest, audits, mark = here, hashlib.sha256(), [], ""
            audits.append(batch.column("audit")[row].as_py())
            turns = batch.column("turns")[row].values
            for role, text in zip(turns.field("role"), turns.field("text")):
                digest.update(f"{mark}{role}:{text}".encode())
                mark = "\n"
    if digest is not None:
        yield done()


def digests(conversations: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The contract's row for each conversation: damage, repair, digest.

    The hash of a conversation needs its turns in order, so a task reads one conversation
    after the other, a block at a time.
    """
    spark = conversations.sparkSession
    found = repair(damaged(conversations), block=block)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = found.blocks.where("alone").select("conv_id", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    rest = (
        found.blocks.where("NOT alone")
        .repartition(parts(spark), "conv_id")
        .sortWithinPartitions("conv_id", "part", "block")
        .select("conv_id", "audit", "turns")
        .mapInArrow(_streamed_digests, "conv_id long, audit string, repaired_sha256 string")
    )
    hashed = alone.unionByName(rest).withColumnRenamed("conv_id", "hashed_id")
    counted = found.conversations
    return counted.join(hashed, counted["conv_id"].eqNullSafe(hashed["hashed_id"])).drop("hashed_id")


def over_conversations(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "conversations"))


_FAR = 1_000_000_000


def _oracle() -> str:
    """The same repair as one fold over each conversation's turns."""

    def grown(state: int, cost: str, edit: str, turn: str | None) -> str:
        out = f"b[{state}].o" if turn is None else f"list_append(b[{state}].o, {turn})"
        return f"{{'c': b[{state}].c + {cost}, 'a': b[{state}].a || '{edit}', 'o': {out}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    insertion = f"""[b[1], b[2],
        {least('b[3]', *(grown(s, '2', 'I', "'user:'") for s in (1, 2, 4)))},
        {least('b[4]', grown(3, '2', 'I', "'assistant:'"))}]"""
    inserted = f"list_reduce([1, 2], lambda b, i: {insertion}, %s)"
    stay = f"CASE r.kind WHEN 2 THEN {_FAR} WHEN 1 THEN 1 ELSE 0 END"

    def kept(state: int, letter: str) -> str:
        cost = f"{stay} + CASE WHEN r.letter = '{letter}' THEN 0 ELSE {_FAR} END"
        return grown(state, cost, "K", "r.role || ':' || r.text")

    def given(state: int, role: str) -> str:
        return grown(state, f"2 + {stay}", "R", f"'{role}:' || r.text")

    deleted = [grown(state, "3", "D", None) for state in (1, 2, 3, 4)]
    step = f"""[{deleted[0]}, {least(deleted[1], kept(1, 's'))},
        {least(deleted[2], *(given(s, 'user') for s in (1, 2, 4)), *(kept(s, 'u') for s in (1, 2, 4)))},
        {least(deleted[3], given(3, 'assistant'), kept(3, 'a'))}]"""
    fold = f"""list_reduce(turns, lambda acc, r: list_transform([{inserted % 'acc'}], lambda b: {step})[1],
        [{{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}}, {', '.join([f"{{'c': {_FAR}::BIGINT, 'a': '', 'o': []::VARCHAR[]}}"] * 3)}])"""
    bits = """list_reduce(range(8), lambda k, i:
        CASE WHEN (k & 1) = 1 THEN xor(k >> 1, 3988292384::UBIGINT) ELSE k >> 1 END, xor(crc, byte))"""
    crc = f"""xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':'
        || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::UBIGINT), lambda crc, byte: {bits},
        4294967295::UBIGINT), 4294967295::UBIGINT) % 20"""
    return f"""
WITH drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS draw FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw > 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
             unhex(sha256(length(role)::VARCHAR || ':' || role || ':' || text))) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM hurt
), faulty AS (
  SELECT *, left(role, 1) AS letter, CASE WHEN body = '' THEN 'blank'
           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
           WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS prior
  FROM ordered
), grouped AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || letter NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'letter': letter, 'role': role, 'text': text,
               'kind': CASE WHEN fault = 'truncated' THEN 1 WHEN fault IS NULL THEN 0 ELSE 2 END}} ORDER BY place) AS turns
  FROM faulty GROUP BY conv_id
), folded AS (
  SELECT * EXCLUDE (turns), {inserted % fold} AS states FROM grouped
), solved AS (
  SELECT * EXCLUDE (states), list_min([states[1], states[4]]) AS best FROM folded
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN solved ON ids.conv_id IS NOT DISTINCT FROM solved.conv_id
"""


ORACLE = _oracle()
