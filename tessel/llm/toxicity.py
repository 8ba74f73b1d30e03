"""Toxicity by a counterfactually regularised linear classifier.

Features are hashed: each distinct word and its prefixes. In every labelled text identity terms are swapped for others
of their group, and a text without any gets pairs of them put in; the squared change of the score is part of the loss,
so mentioning one group or another moves no score. Training takes a bounded sample of labelled rows; all rows are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import id_remainder, sample_order

#: Labelled rows of each class used for training at most.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
DIMENSIONS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: A feature counts if this many texts of the sample have it and a signed likelihood ratio (2 n log) tells the classes apart so far.
LEAST_TEXTS, LEAST_EVIDENCE = 4, 18.0
EPOCHS, BATCH, RATE, L1 = 20, 64, 0.3, 1e-3
#: Weight of the squared score change under a swap.
COUNTERFACTUAL = 1.0
MEMO_WORDS = 250_000
#: Groups of terms that stand for one another in counterfactual texts.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "nonbinary", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "christen", "muslime", "juden", "chrétiens", "musulmans", "juifs", "cristianos", "musulmanes", "judíos"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
)
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_words = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Slots of a word: the word itself and its prefixes."""
    slots = [zlib.crc32(b"w" + word.encode())]
    slots += [zlib.crc32(b"p" + word[:n].encode()) for n in PREFIXES if len(word) > n]
    return [s % DIMENSIONS for s in slots]


def swapped(own: set[str], turn: int) -> set[str] | None:
    """The words with every identity term replaced by another of its group, or None without such terms."""
    terms = own & _GROUP.keys()
    if not terms:
        return None
    other = {g[(g.index(t) + 1 + turn % (len(g) - 1)) % len(g)] for t in terms for g in [_GROUP[t]]}
    return (own - terms) | other


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(s, 0.0) for s in features(word))

    def score(self, text: str | None) -> float:
        return _sigmoid(self.bias + sum(self.of_word(w) for w in sorted(words(text))))


def _sigmoid(x: float) -> float:
    x = max(-30.0, min(30.0, x))
    return float(1 / (1 + np.exp(-x)))


def _evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of presence in a of n texts against b of m, for one shared rate against two."""

    def fit(k: np.ndarray, size: float, rate: np.ndarray) -> np.ndarray:
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        return k * np.log(rate) + (size - k) * np.log(1 - rate)

    shared = (a + b) / (n + m)
    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, shared) - fit(b, m, shared))


def train(texts: list[list[str]], labels: list[int], seed: int = 7) -> Model:
    """Fit on word lists with 0/1 labels. With one class only, every score is that of the class's share."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -3.0)
    slots = [np.array([s for w in t for s in features(w)], np.int64) for t in texts]
    toxic, clean = (np.bincount(np.concatenate([np.unique(s) for s, v in zip(slots, y) if v == k]), minlength=DIMENSIONS).astype(float) for k in (1, 0))
    common = (toxic + clean >= LEAST_TEXTS) & (_evidence(toxic, (y == 1).sum(), clean, (y == 0).sum()) >= LEAST_EVIDENCE)
    identity = [np.array(features(t)) for g in IDENTITY_TERMS for t in g]
    common[np.concatenate(identity)] = True
    rows = [np.unique(s[common[s]], return_counts=True) for s in slots]
    pairs = []  # per text the slots, signed, in which it and its counterfactual differ
    for i, t in enumerate(texts):
        own = set(t)
        other = swapped(own, i)
        if other is None:
            g = IDENTITY_TERMS[i % len(IDENTITY_TERMS)]
            a, b = g[i // 7 % len(g)], g[(i // 7 + 1) % len(g)]
            # Present against absent, and one against the other.
            gone, came = ([a], []) if i % 2 else ([a], [b])
        else:
            gone, came = sorted(own - other), sorted(other - own)
        at = [s for w in gone for s in features(w)], [s for w in came for s in features(w)]
        pairs.append((np.array(at[0] + at[1], np.int64), np.array([1.0] * len(at[0]) + [-1.0] * len(at[1]))))
    weight, squares, bias = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6), 0.0
    held = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~held)
    balance = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)

    def logit(i: int) -> float:
        s, c = rows[i]
        return float(weight[s] @ c) + bias

    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for start in range(0, len(learn), BATCH):
            batch = learn[start : start + BATCH]
            error = np.array([(1 / (1 + np.exp(-np.clip(logit(i), -30, 30))) - y[i]) * balance[i] for i in batch])
            change = np.array([weight[pairs[i][0]] @ pairs[i][1] for i in batch]) * 2 * COUNTERFACTUAL
            at = np.concatenate([np.concatenate([rows[i][0], pairs[i][0]]) for i in batch])
            by = np.concatenate([np.concatenate([rows[i][1] * e, pairs[i][1] * c]) for i, e, c in zip(batch, error, change)]) / len(batch)
            touched, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, by)
            squares[touched] += g * g
            step = RATE / np.sqrt(squares[touched])
            moved = weight[touched] - step * g
            weight[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            bias -= RATE * float(error.mean())
    # The threshold that errs least on the rows kept back becomes score one half.
    checked = np.flatnonzero(held)
    z = np.array([logit(i) for i in checked])
    if len(set(y[checked])) == 2:
        order = np.sort(z)
        cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
        errs = np.array([np.sum(((z >= c) != (y[checked] == 1)) * np.where(y[checked] == 1, 2.0, 1.0)) for c in cuts])
        best = np.flatnonzero(errs == errs.min())
        # Of the cuts that err equally little, one nearer to the clean rows: a single telling word should count.
        bias -= float(0.7 * cuts[best[0]] + 0.3 * cuts[best[-1]])
    kept = np.flatnonzero(weight)
    return Model(dict(zip(kept.tolist(), weight[kept].tolist())), bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", fold: int = 5) -> list[tuple[list[str], int]]:
    """Word lists and labels of a bounded, repeatable sample outside the held-out fold. A key with several labels
    takes the largest, one with several texts the smallest text."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).filter(id_remainder(F.col("k"), fold) != 0)
    pick = lambda y, n: marked.filter(F.col("y") == y).orderBy(sample_order(F.col("k"), 11), "k").limit(n)
    # At most TOXIC_ROWS + CLEAN_ROWS rows of two numbers.
    chosen = F.broadcast(pick(1, TOXIC_ROWS).union(pick(0, CLEAN_ROWS)))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(chosen, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([sorted(words(t)) for t in batch.column("t").to_pylist()], pa.list_(pa.string()))], ["k", "y", "words"])

    # One row per key before anything is gathered, however often a key repeats.
    found = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, y int, words array<string>").groupBy("k", "y").agg(F.min("words").alias("words")).collect()
    return [(list(r["words"]), r["y"]) for r in sorted(found, key=lambda r: r["k"])]


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", fold: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) for every row; a null or empty text scores as one without words."""
    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [words(t) for t in part.column("t").to_pylist()]
                new = set().union(*sets).difference(memo)
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = set().union(*sets)
                for w in new:
                    memo[w] = model.of_word(w)
                # Rounded, so that the order of a sum can't show.
                score = [round(_sigmoid(model.bias + sum([memo[w] for w in s])), 9) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(score, pa.float64())], ["k", "score"])

    scored = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, score double")
    return scored.select(F.col("k").alias(key), (id_remainder(F.col("k"), fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Train on labels outside the held-out fold and score every row of docs. Without labels all scores are alike."""
    sample = labelled_sample(docs, labels, label, text, key)
    return score_documents(docs, train([w for w, _ in sample], [y for _, y in sample]), text, key)
