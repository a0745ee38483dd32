"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult (a lexicon learned from the labels, with weights), threat,
target, negation and reported speech (short fixed lists). One transducer for each of
negation, reported speech and target walks a clause; their product says for each insult
or threat in which reading it stands. A document's features are the weights gathered per
reading, and a logistic model, pulled towards what the grammar expects, scores them.

Learning. Labelled rows with crc32(doc_id as text) mod 5 other than 0 only; of them at
most ``SAMPLE`` rows, those with the smallest hash of the doc_id, and at most ``LEXICON``
entries: words, or beginnings of words, that are in documents of label 1 more often than
chance allows (a likelihood ratio of ``EVIDENCE`` or more). doc_id decides only which
rows are learned from; labels, lang and source never reach a score.

Scoring needs a row's text alone: no shuffle. The model is a few thousand numbers.

Defined results: a null or empty text has no clause and gets the score of such a text,
repeated rows score alike, a doc_id that is null counts as the empty text for the
remainder, labels of other values than 0 and 1 are left out, without any label the fixed
lists alone count, an empty table gives an empty result. Other columns pass through
``stage`` and are left out by ``scores``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.kernels import hash_text, member, text_blocks, trimmed, word_hashes, word_spans
from framewitness.llm.shared import only_text, released, table

#: Labelled rows to learn from at most, and entries of the lexicon at most.
SAMPLE, LEXICON = 30_000, 5_000
#: The likelihood ratio an entry must reach.
EVIDENCE = 22.0
#: Characters of the beginnings of words that may become entries.
_BEGINNINGS = (4, 5, 6, 7)

# The words of the closed classes.
TARGETS = "you your yours u ur they them he she him her du dich dir euch ihr sie tu te toi vous il elle ils tú ti usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie non pas jamais ne nunca jamás tampoco".split()
REPORTS = "said says wrote writes told called claimed reported quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill die hurt destroy murder shoot burn stab töten sterben umbringen tuer mourir frapper matar morir golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What the grammar expects of a reading before any label is seen.
_THREAT_WEIGHT = 3.0


def _transducer(states: int, step) -> np.ndarray:
    return np.array([[step(s, c) for c in range(6)] for s in range(states)])


#: After a negation the next four words are in its scope.
_NEGATED = _transducer(6, lambda s, c: 5 if c == NEGATION else max(0, s - 1))
#: After a verb of saying the rest of the clause is reported.
_REPORTED = _transducer(2, lambda s, c: int(s or c == REPORT))
#: A target holds for the rest of the clause; ``readings`` walks both ways.
_AIMED = _transducer(2, lambda s, c: int(s or c == TARGET))


def compose(*machines: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product machine of the states reached from all zeros, and what they mean."""
    start = (0,) * len(machines)
    seen, table = {start: 0}, []
    for state in (order := [start]):
        row = []
        for c in range(6):
            after = tuple(int(m[s, c]) for m, s in zip(machines, state))
            if after not in seen:
                seen[after] = len(order)
                order.append(after)
            row.append(seen[after])
        table.append(row)
    return np.array(table), order


_TABLE, _STATES = compose(_NEGATED, _REPORTED, _AIMED)
#: Readings: threat or insult, negated, reported, aimed.
READINGS = 16


def readings(classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each reading in one clause."""
    out = np.zeros(READINGS)
    aimed_later = np.cumsum((classes == TARGET)[::-1])[::-1] > 0
    state = 0
    for i, c in enumerate(classes.tolist()):
        state = int(_TABLE[state, c])
        if c in (INSULT, THREAT):
            negated, reported, aimed = _STATES[state]
            reading = 8 * (c == THREAT) + 4 * (negated > 0) + 2 * reported + int(aimed or aimed_later[i])
            out[reading] += weights[i]
    return out


def _expected() -> np.ndarray:
    """The coefficients the model is pulled to: a negated or reported insult weighs less,
    one that is aimed at somebody more."""
    return np.array(
        [
            1.5 * (0.4 if r & 4 else 1.0) * (0.6 if r & 2 else 1.0) * (1.25 if r & 1 else 1.0)
            for r in range(READINGS)
        ]
    )


class Model:
    """Lexicon and coefficients; small enough to travel with a task."""

    def __init__(self, lexicon: dict[str, float], bias: float = -2.0, coefficients=None):
        words: dict[str, tuple[int, float]] = {}
        for kind, some in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            words |= {w: (kind, _THREAT_WEIGHT if kind == THREAT else 0.0) for w in some}
        words |= {w[:-1]: (INSULT, x) for w, x in lexicon.items() if w.endswith("$")}
        begin = {w: x for w, x in lexicon.items() if not w.endswith("$")}
        self.words = _lookup({w: k for w, (k, _) in words.items()}, {w: x for w, (_, x) in words.items()})
        self.beginnings = {
            size: _lookup({w: INSULT for w in some}, some)
            for size in sorted({len(w.encode()) for w in begin})
            if (some := {w: x for w, x in begin.items() if len(w.encode()) == size})
        }
        self.bias = bias
        self.coefficients = _expected() if coefficients is None else coefficients

    def features(self, texts: pa.Array) -> np.ndarray:
        """One row of readings per text; only clauses with an insult or threat are walked."""
        out = np.zeros((len(texts), READINGS))
        order = pa.array(np.arange(len(texts)))
        for places, buffer, bounds in text_blocks(order, pc.utf8_lower(texts)):
            base = places[0].as_py()
            raw_starts, raw_ends, words = word_spans(buffer, bounds)
            if not len(raw_starts):
                continue
            starts, ends = trimmed(buffer, raw_starts, raw_ends)
            classes, weights = self._classes(buffer, starts, ends)
            hot = np.flatnonzero((classes == INSULT) | (classes == THREAT))
            if not len(hot):
                continue
            clause = np.cumsum(self._breaks(buffer, raw_starts, raw_ends, words))
            for c in np.unique(clause[hot]):
                a, b = np.searchsorted(clause, [c, c + 1])
                text = np.searchsorted(words, a, "right") - 1
                out[base + text] += readings(classes[a:b], weights[a:b])
        return np.log1p(out)

    def _classes(self, buffer, starts, ends):
        keys, kinds, scores = self.words
        at = member(word_hashes(buffer, starts, ends), keys)
        classes = np.where(at >= 0, kinds[at], OTHER) if len(keys) else np.zeros(len(starts), int)
        weights = np.where(at >= 0, scores[at], 0.0) if len(keys) else np.zeros(len(starts))
        for size, (keys, _, scores) in self.beginnings.items():
            long = np.flatnonzero((ends - starts >= size) & (classes == OTHER))
            at = member(word_hashes(buffer, starts[long], starts[long] + size), keys)
            classes[long[at >= 0]] = INSULT
            weights[long[at >= 0]] = scores[at[at >= 0]]
        return classes, weights

    @staticmethod
    def _breaks(buffer, starts, ends, words):
        """Whether a clause begins at a word: a text, a line or what follows ``.!?;``."""
        lines = np.cumsum(buffer == 0x0A)
        new = np.ones(len(starts), int)
        new[1:] = lines[starts[1:]] > lines[ends[:-1] - 1]
        new[1:] |= np.isin(buffer[ends[:-1] - 1], [0x2E, 0x21, 0x3F, 0x3B])
        new[words[:-1][words[:-1] < len(starts)]] = 1
        return new

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.features(texts) @ self.coefficients + self.bias)))


def _lookup(kinds: dict[str, int], weights: dict[str, float]):
    keys = np.array([hash_text(w) for w in kinds], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(list(kinds.values()), int)[order], np.array([weights[w] for w in kinds], float)[order]


_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def entries(text: str) -> set[str]:
    """The possible lexicon entries in a text: words (marked ``$``) and beginnings."""
    words = set(_LETTERS.findall(text.lower()))
    found = {w + "$" for w in words if len(w) > 2}
    for size in _BEGINNINGS:
        found |= {w[:size] for w in words if len(w) > size}
    return found


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and coefficients from a bounded sample of the labelled rows."""
    docs = only_text(docs)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out())
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(SAMPLE)
    )
    sample = _sample(docs, chosen)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model({})
    lexicon = _lexicon(sample, bad, good)
    found = sample.mapInArrow(released(_with_features(Model(lexicon))), "toxic int, features array<double>").toPandas()
    x = np.array(found["features"].tolist()).reshape(-1, READINGS)
    bias, coefficients = fit(x, found["toxic"].to_numpy(float), math.log(bad / good))
    return Model(lexicon, bias, coefficients)


def _sample(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """toxic and text: one row for each chosen label that has rows, the smallest of their
    texts, so that there are no more rows than labels."""
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def _lexicon(sample: DataFrame, bad: int, good: int) -> dict[str, float]:
    def count(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                seen[toxic].update(entries(text or ""))
            some = list(seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some + list(seen[0].keys() - seen[1].keys()), pa.string())]
                + [
                    pa.array([seen[k][w] for w in some] + [seen[k][w] for w in seen[0].keys() - seen[1].keys()], pa.int64())
                    for k in (1, 0)
                ],
                names=["entry", "bad", "good"],
            )

    def part(n, total):
        return F.when(n > 0, n * F.log(n / total)).otherwise(F.lit(0.0))

    share = bad / (bad + good)
    counted = (
        sample.mapInArrow(released(count), "entry string, bad long, good long")
        .groupBy("entry")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((F.col("bad") >= 3) & (F.col("bad") * good > 3 * F.col("good") * bad))
    )
    both = F.col("bad") + F.col("good")
    ratio = 2 * (part(F.col("bad"), both * share) + part(F.col("good"), both * (1 - share)))
    top = counted.withColumn("ratio", ratio).where(F.col("ratio") >= EVIDENCE)
    rows = top.orderBy(F.desc("ratio"), "entry").limit(LEXICON).collect()
    weight = {r["entry"]: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1)) for r in rows}
    # A beginning speaks for all that begins with it, if it is as good.
    kept: dict[str, float] = {}
    for entry in sorted(weight, key=lambda e: (len(e.rstrip("$")), e)):
        shorter = [entry[:k] for k in _BEGINNINGS if k < len(entry.rstrip("$")) and entry[:k] in kept]
        if not shorter or weight[entry] > max(kept[s] for s in shorter) + 1:
            kept[entry] = weight[entry]
    return kept


def _with_features(model: Model):
    def run(batches):
        for batch in batches:
            rows = model.features(batch.column("text"))
            flat = pa.array(rows.ravel())
            offsets = pa.array(np.arange(len(rows) + 1) * READINGS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.ListArray.from_arrays(offsets, flat)], names=["toxic", "features"]
            )

    return run


def fit(x: np.ndarray, y: np.ndarray, odds: float, pull: float = 2.0, rounds: int = 30):
    """Logistic regression by Newton steps, pulled to the expected coefficients."""
    full = np.hstack([np.ones((len(x), 1)), x])
    goal = np.append(odds - 1.0, _expected())
    strength = np.append(0.1, np.full(READINGS, pull))
    w = goal.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + strength * (w - goal)
        bend = (full * (p * (1 - p))[:, None]).T @ full + np.diag(strength)
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches):
        for batch in batches:
            found = model.score(batch.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    scored = only_text(docs).mapInArrow(released(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score below 0.5, with all their columns."""
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.string()).fill_null("")
            yield batch.filter(pa.array(model.score(text) < 0.5))

    return docs.mapInArrow(released(run), docs.schema)
