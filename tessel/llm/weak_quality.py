"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or not at all on a text. Votes are counted by pattern over the whole
corpus, and expectation-maximisation on those counts estimates each labeller's accuracy and each pattern's posterior.
The posteriors of a bounded sample train a linear scorer over hashed word shapes and statistics; it scores every text.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import let_go, sample_order

#: Rows whose posteriors train the scorer at most.
SAMPLE_ROWS = 4000
DIMENSIONS = 1 << 12
EPOCHS, BATCH, RATE, L2 = 30, 64, 0.5, 1e-5
EM_ROUNDS, FIRST_BAD, SMOOTH = 100, 2.0, 0.5
KEEP = 0.5
#: Byte classes: a lower case or not ASCII, A upper case, 0 digit, . usual punctuation, # other signs, space.
_CLASS = bytes(0x20 if b in b" \t\n\v\f\r" else 0x61 if chr(b).islower() or b > 127 else 0x41 if 65 <= b <= 90 else 0x30 if 48 <= b <= 57 else 0x2E if b in b".,;:?'\"()-" else 0x23 for b in range(256))


def statistics(text: str | None) -> tuple[dict[str, float], Counter]:
    """Shares that the labellers judge, and counts of the classes of words. A text without words has none."""
    raw = (text or "").encode()
    mapped = raw.translate(_CLASS).split()
    n = len(mapped)
    if not n:
        return {}, Counter()
    kinds = Counter(mapped)
    words, lines = raw.split(), raw.split(b"\n")
    share = lambda test: sum(c for k, c in kinds.items() if test(k)) / n
    return {
        "words": n,
        "signed": share(lambda k: b"#" in k),
        "signs": sum(k.count(b"#") * c for k, c in kinds.items()) / len(raw),
        "shouted": share(lambda k: b"AA" in k),
        "bangs": raw.count(b"!") / n,
        "bare": kinds[b"#"] / n,
        "again": sum(map(operator.eq, words, words[1:])) / n,
        "variety": math.log(len(set(words)) + 1) / math.log(n + 1),
        "ends": share(lambda k: k.endswith(b".")),
        "length": len(raw) / n,
        "digits": sum(k.count(b"0") * c for k, c in kinds.items()) / len(raw),
        "lines": 1 - len(set(lines)) / len(lines),
    }, kinds


def _one_sided(name: str, bad: float):
    return lambda s: 0 if s[name] > bad else None


#: Each labeller votes 1 (good), 0 (bad) or None.
LABELLERS = {
    "signed words": _one_sided("signed", 0.15),
    "sign characters": _one_sided("signs", 0.04),
    "shouted words": _one_sided("shouted", 0.2),
    "exclamations": _one_sided("bangs", 0.15),
    "bare signs": _one_sided("bare", 0.08),
    "repeated words": _one_sided("again", 0.12),
    "variety": lambda s: (0 if s["variety"] < 0.6 else 1 if s["variety"] > 0.7 else None) if s["words"] >= 30 else None,
    "sentence ends": lambda s: (0 if s["ends"] < 0.02 else 1 if 0.04 <= s["ends"] <= 0.5 else None) if s["words"] >= 20 else None,
    "word length": lambda s: 1 if 3.5 <= s["length"] <= 11 else 0 if s["length"] > 25 or s["length"] < 2.2 else None,
    "plain words": lambda s: 1 if s["signed"] < 0.05 and s["shouted"] < 0.05 and s["again"] < 0.05 and s["bare"] < 0.02 else 0 if s["signed"] > 0.15 or s["shouted"] > 0.2 or s["again"] > 0.12 or s["bare"] > 0.08 else None,
    "repeated lines": _one_sided("lines", 0.3),
}


def votes(stats: dict[str, float]) -> str:
    """One of g, b and - per labeller; all - for a text without words."""
    if not stats:
        return "-" * len(LABELLERS)
    return "".join("-" if (v := f(stats)) is None else "bg"[v] for f in LABELLERS.values())


def accuracies(patterns: dict[str, int]) -> tuple[np.ndarray, float, dict[str, float]]:
    """Accuracy of each labeller where it votes, share of good texts, and each pattern's posterior of being good.

    A labeller has its own chances of the three outcomes (good, bad, no vote) on good and on bad texts, for most vote
    good on most texts of either class and only their bad votes tell much. The first posteriors take a bad vote for
    FIRST_BAD good ones.
    """
    keys = sorted(patterns)
    if not keys:
        return np.full(len(LABELLERS), 0.5), 0.5, {}
    count = np.array([patterns[k] for k in keys], float)
    outcome = np.array([[[c == o for o in "gb-"] for c in k] for k in keys], float)  # pattern, labeller, outcome
    ballots = outcome.sum(axis=1)
    q = 1 / (1 + np.exp(-(ballots[:, 0] - FIRST_BAD * ballots[:, 1])))
    for _ in range(EM_ROUNDS):
        on_good = np.einsum("p,plo->lo", count * q, outcome) + SMOOTH
        on_bad = np.einsum("p,plo->lo", count * (1 - q), outcome) + SMOOTH
        good = float(np.clip((count @ q + 1) / (count.sum() + 2), 0.02, 0.98))
        told = np.log(on_good / on_good.sum(axis=1, keepdims=True)) - np.log(on_bad / on_bad.sum(axis=1, keepdims=True))
        z = np.einsum("plo,lo->p", outcome, told) + math.log(good / (1 - good))
        before, q = q, 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(q - before).max() < 1e-9:
            break
    right = (on_good[:, 0] + on_bad[:, 1]) / (on_good[:, :2].sum(axis=1) + on_bad[:, :2].sum(axis=1))
    return right, good, dict(zip(keys, q.tolist()))


_EDGES = {"signed": (0.01, 0.03, 0.08, 0.15, 0.3, 0.6), "shouted": (0.01, 0.05, 0.1, 0.2, 0.5), "bangs": (0.01, 0.05, 0.15, 0.5), "bare": (0.005, 0.02, 0.08, 0.2), "again": (0.01, 0.05, 0.12, 0.3, 0.6), "variety": (0.3, 0.5, 0.6, 0.7, 0.8), "ends": (0.01, 0.02, 0.04, 0.1, 0.2, 0.5), "length": (2.2, 3.5, 5, 7, 9, 11, 15, 25), "digits": (0.01, 0.05, 0.2), "lines": (0.05, 0.15, 0.3, 0.6)}


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


def _shape(kind: bytes) -> str:
    """Runs of a class as one letter."""
    out = chr(kind[0])
    for a, b in zip(kind, kind[1:]):
        if a != b:
            out += chr(b)
    return out


def features(stats: dict[str, float], kinds: Counter, memo: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: the share of words of each shape, and the interval each statistic falls into."""
    memo = {} if memo is None else memo
    if not stats:
        return np.array([_slot("empty")]), np.ones(1)
    out: dict[int, float] = {}
    for k, c in kinds.items():
        if (s := memo.get(k)) is None:
            s = _slot("shape " + _shape(k))
            if len(k) <= 32 and len(memo) < 50_000:
                memo[k] = s
        out[s] = out.get(s, 0.0) + c / stats["words"]
    for name, edges in _EDGES.items():
        s = _slot(f"{name} {sum(stats[name] >= e for e in edges)}")
        out[s] = out.get(s, 0.0) + 0.5
    return np.fromiter(out.keys(), np.int64), np.fromiter(out.values(), float)


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weight[slots] @ values) + self.bias))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: list[float], seed: int = 5) -> Scorer:
    """Logistic regression on soft targets; without rows every text is good."""
    model, rng = Scorer(np.zeros(DIMENSIONS), 2.0), np.random.default_rng(seed)
    squares, order = np.full(DIMENSIONS, 1e-6), np.arange(len(rows))
    for _ in range(EPOCHS if rows else 0):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            error = np.array([model.score(*rows[i]) - target[i] for i in batch])
            g = np.zeros(DIMENSIONS)
            for i, e in zip(batch, error):
                g[rows[i][0]] += rows[i][1] * (e / len(batch))
            g += L2 * model.weight
            squares += g * g
            model.weight -= RATE * g / np.sqrt(squares)
            model.bias -= RATE * float(error.mean())
    return model


def _described(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))


def label_patterns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, int]:
    """How many rows of docs each vote pattern has; at most three to the number of labellers. Null and empty texts have
    the pattern without votes; an empty table has no patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                seen.update(votes(statistics(t)[0]) for t in batch.slice(at, 512).column("t").to_pylist())
        let_go()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["votes", "rows"])

    counted = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "votes string, rows long")
    return {r["votes"]: r["rows"] for r in counted.groupBy("votes").agg(F.sum("rows").alias("rows")).collect()}


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Scorer, dict[str, float], np.ndarray]:
    """The scorer, the posteriors by pattern and the labellers' accuracies. Rows without key are counted, not sampled; a
    key that repeats is sampled once; without any row the scorer keeps every text."""
    accuracy, _, posterior = accuracies(label_patterns(docs, text, key))
    ids = docs.select(F.col(f"`{key}`").alias("k")).filter("k IS NOT NULL").distinct().orderBy(sample_order(F.col("k"), 23), "k").limit(SAMPLE_ROWS)
    rows = _described(docs, text, key).join(F.broadcast(ids), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(votes(s), *features(s, kinds)) for s, kinds in map(statistics, batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))], ["k", "votes", "slots", "vals"])

    described = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, votes string, slots array<long>, vals array<double>")
    # One row per key before anything is gathered, however often a key repeats.
    found = described.groupBy("k").agg(F.min(F.struct("votes", "slots", "vals")).alias("r")).select("k", "r.*").collect()
    found = sorted(found, key=lambda r: r["k"])
    model = train([(np.array(r["slots"], np.int64), np.array(r["vals"])) for r in found], [posterior[r["votes"]] for r in found])
    return model, posterior, accuracy


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, keep, votes, posterior) for every row: score from 0 to 1, keep where it is at least KEEP.

    Texts are read whole, however long; an empty table gives an empty one. A null or empty text has no votes and is judged by the scorer as an empty text. Equal texts are judged alike, and
    repeated rows, null keys and other columns change nothing for the rest.
    """
    model, posterior, _ = fit(docs, text, key)
    source = _described(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score, voted = [], []
                for t in part.column("t").to_pylist():
                    stats, kinds = statistics(t)
                    score.append(round(model.score(*features(stats, kinds, memo)), 9))
                    voted.append(votes(stats))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(score, pa.float64()), pa.array([s >= KEEP for s in score], pa.bool_()), pa.array(voted, pa.string()), pa.array([posterior.get(v) for v in voted], pa.float64())], ["k", "score", "keep", "votes", "posterior"])
        let_go()

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, score double, keep boolean, votes string, posterior double").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that the scorer keeps, columns as they are; one pass, without a join.

    A null or empty text is judged as an empty text, a text however long as a whole, equal texts alike, and each
    repeated row for itself. An empty table gives an empty one; columns may have any names.
    """
    model, _, _ = fit(docs, text, key)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = [model.score(*features(*statistics(t), memo)) >= KEEP for t in part.column(at_text).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))
        let_go()

    return docs.mapInArrow(run, docs.schema)
