"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples.

Each k-mer of code points carries the number of earlier equal k-mers, so repeats count as different elements. Each of
SKETCH places takes its TUPLE minimal elements, puts them back in text order and hashes their sequence; two texts agree
in a place only if the same k-mers are minimal and stand in the same order. A first round deals every element to one
place by its hash; while a place has fewer than TUPLE elements, another round deals all elements anew with larger
values, so a long text is hashed about once and a short one as often as it takes (fast similarity sketching, applied to
tuples). A text with fewer than TUPLE k-mers takes them all in every place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import bit_mix, shuffle_width

K = 10
TUPLE = 2
SKETCH = 64
#: Rounds by hash; the places still short after these are filled one by one from all elements.
ROUNDS = 24
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_POS = _U(24)


def _kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer; a text shorter than k has one k-mer, all of it. Polynomial in wrapping 64 bits, then mixed."""
    if len(points) <= k:
        points, k = points, len(points)
    x = points.astype(np.uint64) + _U(1)
    # Windows of 1, 2, 4 ... points are joined as k's binary digits ask.
    h, size, window, span = None, 0, x, 1
    while True:
        if k & span:
            if h is None:
                h, size = window, span
            else:
                n = len(h) - span
                h, size = h[:n] * _U(pow(_BASE, span, 1 << 64)) + window[size : size + n], size + span
        if span * 2 > k:
            break
        window = window[:-span] * _U(pow(_BASE, span, 1 << 64)) + window[span:]
        span *= 2
    h = (h + _U(k)) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32))) * _U(_BASE)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    if len(h) < 1 << 24:
        # One sort of hash and position in a word: the low bits of the hash give way to the position.
        packed = (h & ~_U((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        packed.sort()
        order = (packed & _U((1 << 24) - 1)).astype(np.int64)
        same = (packed[1:] >> _POS) == (packed[:-1] >> _POS)
    else:
        order = np.argsort(h >> _POS, kind="stable")
        s = h[order] >> _POS
        same = s[1:] == s[:-1]
    out = np.zeros(len(h), np.uint64)
    if same.any():
        first = np.append(0, np.flatnonzero(~same) + 1)
        run = np.repeat(first, np.diff(np.append(first, len(h))))
        out[order] = (np.arange(len(h)) - run).astype(np.uint64)
    return out


def sketch(text: str, k: int = K, size: int = SKETCH, length: int = TUPLE) -> np.ndarray:
    """The signature: size hashes of 16 bits. An empty text has no k-mers; its signature is all zero."""
    if not text:
        return np.zeros(size, np.uint16)
    h = _kmer_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    base = h & ~_U((1 << 24) - 1)
    element = base + _occurrences(h) * _U(0xD6E8FEB86659FD93)
    n, length = len(element), min(length, len(element))
    taken = np.full((size, length), -1, np.int64)
    have = np.zeros(size, np.int64)
    if n == length:
        taken[:], have[:] = np.arange(n), n
    for r in range(ROUNDS if n > length else 0):
        value = bit_mix(element + _U((r + 1) * _BASE & (1 << 64) - 1))
        place = ((value >> _U(32)) * _U(size)) >> _U(32)
        keys = (place.astype(np.uint64) << _U(57)) | ((value & _U(0xFFFFFFFF)) << _U(25)) if n < 1 << 25 else None
        if keys is not None:
            keys |= np.arange(n, dtype=np.uint64)
            keys.sort()
            order, of = (keys & _U((1 << 25) - 1)).astype(np.int64), (keys >> _U(57)).astype(np.int64)
        else:
            order = np.lexsort((value & _U(0xFFFFFFFF), place))
            of = place[order].astype(np.int64)
        ends = np.searchsorted(of, np.arange(size + 1))
        if r == 0:
            for c in range(length):
                ok = ends[:-1] + c < ends[1:]
                taken[ok, c] = order[(ends[:-1] + c)[ok]]
            have = np.minimum(np.diff(ends), length)
        else:
            for p in np.flatnonzero(have < length):
                for e in order[ends[p] : ends[p + 1]]:
                    if have[p] < length and e not in taken[p, : have[p]]:
                        taken[p, have[p]] = e
                        have[p] += 1
        if (have == length).all():
            break
    for p in np.flatnonzero(have < length):
        order = np.argsort(bit_mix(element ^ _U((int(p) + 1) * _BASE & (1 << 64) - 1)), kind="stable")
        for e in order:
            if have[p] == length:
                break
            if e not in taken[p, : have[p]]:
                taken[p, have[p]] = e
                have[p] += 1
    taken.sort(axis=1)
    out = np.full(size, length, np.uint64)
    for c in range(length):
        out = bit_mix(out * _U(_BASE) + base[taken[:, c]])
    return (out >> _U(48)).astype(np.uint16)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of places in which two signatures agree."""
    return float(np.count_nonzero(a == b)) / len(a)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Signature of each whole text, however long, as hex. A null text counts as empty; equal texts have equal
    fingerprints, repeated rows repeated results, an empty table none; other columns are ignored, whatever their names."""
    source = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [to_hex(sketch(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.string())], ["k", "fingerprint"])

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, fingerprint string").withColumnRenamed("k", key)


def _constant(values: list) -> Column:
    """An array of whole numbers as one folded constant."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _passed(value: Column, bounds: list[int]) -> Column:
    """How many of the falling bounds are at or above value, by bisection."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    cuts = _constant(bounds)
    go = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(cuts, at + step - 1) >= value), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), go) if steps else F.lit(0)


def edited_fingerprints(docs: DataFrame, width: int | None = None) -> DataFrame:
    """Fingerprint each whole text of documents and its edited text, and compare it with the edited and the next one.

    The next document is the one after in descending doc_id, ties by text; after the last comes the first. Rows without
    doc_id come last. Documents are dealt by ranges of doc_id; the first document of a range also goes to the range
    before it, so each text moves once and no range is held by the driver. One document alone follows itself.
    """
    spark = docs.sparkSession
    width = width or shuffle_width(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    # Bounds of at most width ranges, and the highest id in each: both as long as the number of ranges.
    bounds = source.select(F.percentile_approx("doc_id", [i / width for i in range(1, width)], 10_000)).first()[0] if width > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    # Ids above the highest bound are range 0; each bound passed is one range further; no id is the last range of all.
    placed = source.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_passed(F.col("doc_id"), bounds)))
    heads = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    present = sorted(heads)
    before = {p: present[i - 1] for i, p in enumerate(present)}
    # Looked up by range: its highest id, and the range before it (the last one for the first).
    by_range = lambda found: _constant([found.get(p) for p in range(len(bounds) + 2)])
    helper = F.when(F.col("doc_id").eqNullSafe(F.get(by_range(heads), F.col("range"))), F.get(by_range(before), F.col("range")))
    dealt = placed.select("doc_id", "t", F.explode(F.filter(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("extra")), F.struct(helper.cast("int").alias("at"), F.lit(True).alias("extra"))), lambda s: s["at"].isNotNull())).alias("s")).select("s.at", "s.extra", "doc_id", "t")
    # Each range is a partition of its own; hashing them would put several into one.
    sorted_ = dealt.repartitionById(len(bounds) + 2, "at").sortWithinPartitions("at", "extra", F.col("doc_id").desc_nulls_last(), "t")

    result = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(one: tuple, following: tuple) -> dict:
        (doc_id, t, own), (next_t, next_own) = one, following
        edited = edited_text(t, next_t)
        other = sketch(edited) if edited != t else own
        return {"doc_id": doc_id, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": to_hex(own), "edited_fingerprint": to_hex(other), "near_edited": likeness(own, other), "near_next": likeness(own, next_own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, closed = None, None, True  # the row that waits for its follower, its range, and whether it found one
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ready = []
                for r, extra, doc_id, t in zip(*[part.column(n).to_pylist() for n in ("at", "extra", "doc_id", "t")]):
                    if extra and closed and r == at:
                        continue  # further rows of the next range's first id
                    row = (doc_id, t, sketch(t))
                    if held is not None:
                        ready.append((held, row[1:]))
                    held, at, closed = (None, r, True) if extra else (row, r, False)
                yield pa.RecordBatch.from_pylist([compare(*pair) for pair in ready], schema=result)

    return sorted_.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
