"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two deterministic transducers replace the tokenizer:

* the splitter reads character classes and says where the pattern's matches begin. Its
  table has a dozen states. A block of texts is cut into chunks of ``CHUNK`` characters
  wherever they fall; each chunk's state map (the state it ends in, for each state it may
  begin in) is made for all chunks at once, the maps compose by a parallel prefix scan,
  and with its true first state each chunk then emits its borders;
* the counter reads the bytes of a match. A state holds, for each stretch before it that a
  token may yet continue, the last token before that stretch and how many tokens fewer
  lie there; the transition over a byte is annotated with the change of the token count,
  so that the sum over a match is its number of tokens. Transitions are determined when
  first met and kept in a table of bounded size, which starts anew when it is full.

At a match's border the counter is in its first state whatever came before. Matches are
therefore chunks with constant state maps, whose counts add up by prefix sums.

A row needs nothing but its text: no shuffle, nothing collected or broadcast.

Defined results: a null text counts as empty, with no bytes and tokens; the strings of
special tokens are one token each and cut the text, as the library has it by default;
repeated rows count alike; texts are never cut short; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewitness.llm.byte_bpe import byte_characters
from framewitness.llm.kernels import mixed, text_blocks
from framewitness.llm.shared import only_text

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256
#: Transitions of the counter that a task keeps at most.
TRANSITIONS = 1 << 20

# Character classes of the splitter; END closes a text.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, TWO, E, L, END = range(11)


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((BLANK, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern + "+", chars))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for kind, some in ((SPACE, " "), (QUOTE, "'"), (ONE, "stmd"), (TWO, "rv"), (E, "e"), (L, "l")):
        out[[ord(c) for c in some]] = kind
    return out


#: States of the splitter. Runs of white space are told apart by length (one, more) and
#: by their last character (space, blank). QUOTED stands after a quote that began a match.
FRESH, WORD, DIGITS, MARKS, SPACE1, BLANK1, SPACES, BLANKS, QUOTED, QUOTED_TWO, QUOTED_L, SHORT = range(12)
_LETTERS = (LETTER, ONE, TWO, E, L)


def _family(kind: int) -> int:
    """The state a character leads to when it begins or continues a match."""
    if kind in _LETTERS:
        return WORD
    return {NUMBER: DIGITS, OTHER: MARKS, QUOTE: MARKS}[kind]


def _step(state: int, kind: int) -> tuple[int, int, int]:
    """After a class: the state, whether a match begins here, whether one did one before."""
    if state in (QUOTED_TWO, QUOTED_L):
        if kind == (E if state == QUOTED_TWO else L):
            return SHORT, 0, 0
        # No short form: the quote was a match of its own and a word began after it.
        after, here, _ = _step(WORD, kind)
        return after, here, 1
    if kind == END:
        return FRESH, 0, 0
    if kind in (SPACE, BLANK):
        if state in (SPACE1, BLANK1, SPACES, BLANKS):
            return (SPACES if kind == SPACE else BLANKS), 0, 0
        return (SPACE1 if kind == SPACE else BLANK1), 1, 0
    # A run of more than one leaves its last character to what follows.
    before = int(state in (SPACES, BLANKS))
    if state in (SPACE1, SPACES):
        return _family(kind), 0, before
    if state in (BLANK1, BLANKS, FRESH, SHORT):
        return (QUOTED if kind == QUOTE else _family(kind)), 1, before
    if state == QUOTED:
        if kind == ONE:
            return SHORT, 0, 0
        if kind in (TWO, L):
            return (QUOTED_TWO if kind == TWO else QUOTED_L), 0, 0
        return _family(kind), int(_family(kind) != MARKS), 0
    if _family(kind) == state:
        return state, 0, 0
    return (QUOTED if kind == QUOTE else _family(kind)), 1, 0


_RULES = np.array([[_step(s, k) for k in range(11)] for s in range(12)])
_NEXT = _RULES[:, :, 0].astype(np.uint8)
_HERE, _BEFORE = _RULES[:, :, 1].astype(bool), _RULES[:, :, 2].astype(bool)


def state_maps(chunks: np.ndarray) -> np.ndarray:
    """For each chunk (a row of classes) and each first state, the last state."""
    maps = np.repeat(np.arange(12, dtype=np.uint8)[None], len(chunks), 0)
    lanes, step = np.arange(len(chunks)), 0
    # Nearly all maps are constant after some characters; then one lane tells all.
    while step < chunks.shape[1] and len(lanes):
        for step in range(step, min(step + 8, chunks.shape[1])):
            maps[lanes] = _NEXT[maps[lanes], chunks[lanes, step][:, None]]
        step += 1
        constant = (maps[lanes] == maps[lanes, :1]).all(1)
        done = lanes[constant]
        state = maps[done, 0]
        for k in range(step, chunks.shape[1]):
            state = _NEXT[state, chunks[done, k]]
        maps[done] = state[:, None]
        lanes = lanes[~constant]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps up to each chunk, by doubling."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), 1)
        reach *= 2
    return out


def match_starts(classes: np.ndarray) -> np.ndarray:
    """Where matches begin, in a sequence of classes with an END after each text."""
    n = len(classes)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = classes
    chunks = padded.reshape(-1, CHUNK)
    ends = prefix_scan(state_maps(chunks))[:, FRESH]
    state = np.append(np.uint8(FRESH), ends[:-1])
    starts = np.zeros(padded.size + 1, bool)  # one place before the first for ``before``
    here, before = starts[1:].reshape(chunks.shape), np.zeros(chunks.shape, bool)
    for k in range(CHUNK):
        kind = chunks[:, k]
        here[:, k] = _HERE[state, kind]
        before[:, k] = _BEFORE[state, kind]
        state = _NEXT[state, kind]
    starts[:-1] |= before.reshape(-1)
    return starts[1 : n + 1]


class Counter:
    """The counting transducer of a vocabulary, determined as texts need it."""

    def __init__(self, name: str = TOKENIZER):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path) as file:
            self.special = [t["content"].encode() for t in json.load(file)["added_tokens"] if t["special"]]
        self._model = Tokenizer.from_file(path).model
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = json.load(open(path))["model"]["vocab"]
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        self._said = {i: said for said, i in vocabulary.items()}
        for said, i in vocabulary.items():
            if said.encode() in self.special or self._plain(said) != [i]:
                continue  # no text leads to such a token
            node = 0
            for c in said:
                node = self._children[node].setdefault(byte[c], len(self._children))
                if node == len(self._children):
                    self._children.append({})
                    self._token.append(-1)
            self._token[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _plain(self, said: str) -> list[int]:
        return [t.id for t in self._model.tokenize(said)]

    def _reset(self) -> None:
        # The first state: nothing before, no token yet.
        self._states = [((0, -1, 0),)]
        self._numbers = {self._states[0]: 0}
        self._keys = np.full(2 * TRANSITIONS, -1, np.int64)
        self._values = np.zeros(2 * TRANSITIONS, np.int64)
        self._known = 0

    def _fit(self, last: int, token: int) -> bool:
        """Whether the two tokens stay as they are when side by side."""
        pair = (last, token)
        if pair not in self._fits:
            if len(self._fits) > TRANSITIONS:
                self._fits.clear()
            self._fits[pair] = self._plain(self._said[last] + self._said[token]) == [last, token]
        return self._fits[pair]

    def _after(self, state, byte: int):
        """The next state and the change of the count over a byte."""
        last = count = None
        going = []
        for node, before, behind in state:
            child = self._children[node].get(byte)
            if child is None:
                continue
            token = self._token[child]
            if last is None and token >= 0 and (before < 0 or self._fit(before, token)):
                last, count = token, 1 - behind
            if self._children[child]:
                going.append((child, before, behind))
        return (*((c, b, k + count) for c, b, k in going), (0, last, 0)), count

    def _number(self, state) -> int:
        number = self._numbers.setdefault(state, len(self._states))
        if number == len(self._states):
            self._states.append(state)
        return number

    def _learn(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        slots = (_slot(keys) & (2 * TRANSITIONS - 1)).tolist()
        for key, slot in zip(keys.tolist(), slots):
            state, change = self._after(self._states[key >> 8], key & 255)
            number = self._number(state)
            while self._keys[slot] >= 0:
                slot = (slot + 1) & (2 * TRANSITIONS - 1)
            self._keys[slot], self._values[slot] = key, (number << 16) + change + (1 << 15)
            self._known += 1

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and which are not known."""
        slot = _slot(keys) & (2 * TRANSITIONS - 1)
        values, missing = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        going = np.arange(len(keys))
        while len(going):
            there = self._keys[slot[going]]
            hit = there == keys[going]
            values[going[hit]] = self._values[slot[going[hit]]]
            missing[going[there < 0]] = True
            going = going[~hit & (there >= 0)]
            slot[going] = (slot[going] + 1) & (2 * TRANSITIONS - 1)
        return values, missing

    def count(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each match [start, end); all matches take a step at once."""
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        lengths = (ends - starts)[order]
        first, state, total = starts[order], np.zeros(len(starts), np.int64), counts[order]
        step, active = 0, len(starts)
        if self._known > 3 * TRANSITIONS // 4:
            self._reset()
        while active:
            active = int(np.searchsorted(-lengths, -step, "left"))
            if not active:
                break
            keys = (state[:active] << 8) | buffer[first[:active] + step]
            values, missing = self._find(keys)
            if missing.any():
                if self._known + len(np.unique(keys[missing])) > TRANSITIONS:
                    # Full: begin anew with the states that the matches are in.
                    used, back = np.unique(state[:active], return_inverse=True)
                    going = [self._states[k] for k in used.tolist()]
                    self._reset()
                    state[:active] = np.array([self._number(s) for s in going])[back]
                    keys = (state[:active] << 8) | buffer[first[:active] + step]
                    missing = np.ones(active, bool)
                self._learn(keys[missing])
                values, _ = self._find(keys)
            state[:active] = values >> 16
            total[:active] += (values & 0xFFFF) - (1 << 15)
            step += 1
        counts[order] = total
        return counts


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) >> np.uint64(20)).astype(np.int64)


@lru_cache(2)
def load(name: str = TOKENIZER) -> Counter:
    return Counter(name)


def _sections(buffer, bounds, special: list[bytes]):
    """The block without special strings: buffer, bounds, the text of each section and
    the special strings of each text."""
    found = np.zeros(len(bounds) - 1, np.int64)
    data = buffer.tobytes()
    if not any(s in data for s in special):
        return buffer, bounds, np.arange(len(bounds) - 1), found
    cut = regex.compile(b"|".join(map(regex.escape, special)))
    pieces, owner = [], []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        some = cut.split(data[a:b])
        found[i] = len(some) - 1
        pieces += some
        owner += [i] * len(some)
    cuts = np.append(0, np.cumsum([len(p) for p in pieces]))
    return np.frombuffer(b"".join(pieces), np.uint8), cuts, np.array(owner), found


def count_tokens(buffer, bounds, name: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text of a block."""
    counter = load(name)
    buffer, bounds, owner, out = _sections(buffer, bounds, counter.special)
    if not len(buffer):
        return out
    points = np.frombuffer(buffer.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((buffer & 0xC0) != 0x80)  # the byte at which each character begins
    cuts = np.searchsorted(at, bounds)
    section = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    classes = np.full(len(points) + len(cuts) - 1, END, np.uint8)
    place = np.arange(len(points)) + section
    classes[place] = character_classes()[points]
    starts = np.flatnonzero(match_starts(classes)[place])
    begin = at[starts]
    # A match ends where the next one begins; the sections lie end to end.
    counts = counter.count(buffer, begin, np.append(begin[1:], len(buffer)))
    sums = np.append(0, np.cumsum(counts))[np.searchsorted(begin, bounds)]
    np.add.at(out, owner, np.diff(sums))
    return out


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(batches):
        for batch in batches:
            for ids, buffer, bounds in text_blocks(batch.column("doc_id"), batch.column("text")):
                n = count_tokens(buffer, bounds, name)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(bounds), pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return only_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
