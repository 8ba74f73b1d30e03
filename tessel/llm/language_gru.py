"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a whole text in lower case, as bytes between spaces: its states run on from word to word, both ways,
it labels every position, and a document's probabilities are the mean over all its positions. A text is read in windows
of WINDOW positions; a direction's state at the edge of a window comes from the CONTEXT bytes that it has read before,
so a text of any length takes bounded memory and all windows of a batch advance together. Training is by
backpropagation through time on the whole texts of a bounded sample of the documents that have a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.shared import id_remainder, let_go, sample_order, text_slices

HIDDEN = 16
#: Positions labelled at once, the last window of a text to a multiple of STEP; bytes that are read before them.
WINDOW, STEP, CONTEXT = 256, 64, 48
#: Documents that the sample takes over all languages at most, and bytes of their texts that train as one sequence.
SAMPLE_DOCUMENTS, SEQUENCE = 480, 96
EPOCHS, BATCH, RATE = 4, 128, 0.02
#: Steps of training at least, so that a small sample is gone through more often.
LEAST_STEPS = 150
#: Windows that a worker reads together, and characters of text from which it reads them.
TOGETHER, SLICE_CHARS = 2048, 1 << 19
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search


def _gate(x: np.ndarray) -> np.ndarray:
    """A straight line for the logistic curve, as steep as that in its middle: it costs no exponential."""
    return np.clip(x * 0.25 + 0.5, 0, 1)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, each with its context on both sides, and how many of its positions are the text's.

    Rows are as wide as WINDOW and two contexts; the last one's text ends after a multiple of STEP, spaces follow.
    """
    raw = text.lower().encode()
    n = len(raw)
    count = max(1, -(-n // WINDOW))
    padded = np.full(count * WINDOW + 2 * CONTEXT, 32, np.uint8)
    padded[CONTEXT : CONTEXT + n] = np.frombuffer(raw, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 2 * CONTEXT)[::WINDOW]
    own = np.full(count, WINDOW)
    own[-1] = n - (count - 1) * WINDOW
    return rows, own


class BiGRU:
    """Two gated recurrent layers, one per direction, and a softmax over both states at each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(dtype)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(dtype)
            self.p["c" + d] = np.zeros(hidden, dtype)
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(dtype)
        self.p["ob"] = np.zeros(classes, dtype)

    def _run(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """States after each position, in the order of reading: (time, batch, hidden). mask is 0 past a sequence's end."""
        h, n = self.hidden, x.shape[1]
        inputs, u, c = self.p["x" + d][x.T], self.p["u" + d], self.p["c" + d]
        state, out = np.zeros((len(x), h), inputs.dtype), np.empty((n, len(x), h), inputs.dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            rec = state @ u
            gates = _gate(inputs[t, :, : 2 * h] + rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            inner = rec[:, 2 * h :] + c
            cand = np.tanh(inputs[t, :, 2 * h :] + r * inner)
            new = cand + z * (state - cand)
            if mask is not None:
                new = np.where(mask[:, t : t + 1], new, state)
            if keep is not None:
                keep.append((t, state, z, r, inner, cand))
            state = out[t] = new
        return out

    def _read(self, x: np.ndarray, d: str, skip: int, keep: np.ndarray) -> None:
        """The states of one direction after each position but the first skip ones it reads, into keep (time, batch,
        hidden). As _run without mask, step for step in place."""
        h, (n, batch), kind = self.hidden, x.shape, self.p["u" + d].dtype
        table, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        gate_table, cand_table = table[:, : 2 * h] * kind.type(0.25) + kind.type(0.5), np.ascontiguousarray(table[:, 2 * h :])
        gate_u, cand_u = u[:, : 2 * h] * kind.type(0.25), np.ascontiguousarray(u[:, 2 * h :])
        state, new = np.zeros((batch, h), kind), np.empty((batch, h), kind)
        gates, by_state, cand, inner = np.empty((batch, 2 * h), kind), np.empty((batch, 2 * h), kind), np.empty((batch, h), kind), np.empty((batch, h), kind)
        for i, t in enumerate(range(n) if d == "f" else range(n - 1, -1, -1)):
            np.take(gate_table, x[t], axis=0, out=gates, mode="clip")
            np.take(cand_table, x[t], axis=0, out=cand, mode="clip")
            np.matmul(state, gate_u, out=by_state)
            gates += by_state
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            np.matmul(state, cand_u, out=inner)
            inner += c
            inner *= gates[:, h:]
            cand += inner
            # tanh v = 1 - 2 / (1 + exp 2v); beyond 20 it is 1 anyway.
            np.minimum(cand, 20, out=cand)
            cand *= 2
            np.exp(cand, out=cand)
            cand += 1
            np.divide(-2, cand, out=cand)
            cand += 1
            np.subtract(state, cand, out=new)
            new *= gates[:, :h]
            new += cand
            state, new = new, state
            if i >= skip:
                keep[t - skip if d == "f" else t] = state

    def window_sums(self, rows: np.ndarray, own: np.ndarray, context: int = CONTEXT) -> np.ndarray:
        """Per row the probabilities summed over its first own positions after the context."""
        n, x = rows.shape[1] - 2 * context, np.ascontiguousarray(rows.T)
        both = np.empty((n, len(rows), 2 * self.hidden), self.p["o"].dtype)
        self._read(x[: n + context], "f", context, both[:, :, : self.hidden])
        self._read(x[context:], "b", context, both[:, :, self.hidden :])
        out, weights, bias = np.zeros((self.classes, len(rows))), np.ascontiguousarray(self.p["o"].T), self.p["ob"][:, None]
        for t in range(n):
            z = weights @ both[t].T
            z += bias
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z *= (own > t) / z.sum(axis=0)
            out += z
        return out.T

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Per text the mean of its positions' probabilities; texts have a byte at least."""
        rows, own, of = [], [], []
        for i, t in enumerate(texts):
            r, o = windows(t)
            rows.append(r)
            own.append(o)
            of.append(np.full(len(o), i))
        rows, own, of = np.concatenate(rows), np.concatenate(own), np.concatenate(of)
        sums = np.zeros((len(texts), self.classes))
        wide = -(-own // STEP) * STEP
        for w in np.unique(wide):
            at = np.flatnonzero(wide == w)
            for start in range(0, len(at), TOGETHER):
                part = at[start : start + TOGETHER]
                np.add.at(sums, of[part], self.window_sums(rows[part, : w + 2 * CONTEXT], own[part]))
        return sums / sums.sum(axis=1, keepdims=True)

    def loss_and_gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        h, total = self.hidden, mask.sum()
        steps = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, steps[d]) for d in "fb"], axis=2)
        z = both @ self.p["o"] + self.p["ob"]
        z = z - z.max(axis=2, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=2, keepdims=True)
        weight = (mask.T / total)[:, :, None].astype(both.dtype)
        picked = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*prob.shape[:2], 1)), axis=2)
        loss = float(-(np.log(picked + 1e-12) * weight).sum())
        dz = prob * weight
        np.put_along_axis(dz, np.broadcast_to(y[None, :, None], (*prob.shape[:2], 1)), np.take_along_axis(dz, np.broadcast_to(y[None, :, None], (*prob.shape[:2], 1)), axis=2) - weight, axis=2)
        g = {"o": np.einsum("tbh,tbc->hc", both, dz), "ob": dz.sum(axis=(0, 1))}
        dboth = dz @ self.p["o"].T
        # Positions by byte, to add up each byte's gradients.
        order = np.argsort(x.T.ravel(), kind="stable")
        present, first = np.unique(x.T.ravel()[order], return_index=True)
        for i, d in enumerate("fb"):
            dout, u = dboth[:, :, i * h : (i + 1) * h], self.p["u" + d]
            du, dc = np.zeros_like(u), np.zeros_like(self.p["c" + d])
            dinput = np.zeros((x.shape[1], len(x), 3 * h), u.dtype)
            ds = np.zeros((len(x), h), u.dtype)
            for t, state, zt, r, inner, cand in reversed(steps[d]):
                m = mask[:, t : t + 1]
                dn = ds + dout[t]
                dnew, passed = np.where(m, dn, 0), np.where(m, 0, dn)
                dzt, dcand = dnew * (state - cand), dnew * (1 - zt)
                da = dcand * (1 - cand * cand)
                dr, dinner = da * inner, da * r
                dgate = np.concatenate([dzt * ((zt > 0) & (zt < 1)), dr * ((r > 0) & (r < 1))], axis=1) * u.dtype.type(0.25)
                drec = np.concatenate([dgate, dinner], axis=1)
                dinput[t] = np.concatenate([dgate, da], axis=1)
                du += state.T @ drec
                dc += dinner.sum(axis=0)
                ds = dnew * zt + drec @ u.T + passed
            g["x" + d], g["u" + d], g["c" + d] = np.zeros_like(self.p["x" + d]), du, dc
            g["x" + d][present] = np.add.reduceat(dinput.reshape(-1, 3 * h)[order], first, axis=0)
        return loss, g

    def train(self, sequences: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> None:
        """Adam over batches of sequences of like length; every position of a sequence has its label."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order, step = np.argsort([len(s) for s in sequences], kind="stable"), 0
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                rows = [sequences[i] for i in batches[b]]
                width = max(map(len, rows))
                x = np.frombuffer(b"".join(s.ljust(width) for s in rows), np.uint8).reshape(len(rows), width)
                mask = np.arange(width)[None, :] < np.array([len(s) for s in rows])[:, None]
                _, g = self.loss_and_gradients(x, mask, labels[batches[b]])
                rate = RATE / (1 + 3 * step / (epochs * len(batches)))
                step += 1
                rate *= np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in self.p:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.001 * (g[k] ** 2 - second[k])
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(self.p[k].dtype)


def sample_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", modulus: int = 3, held: int = 1) -> list[tuple[str, str]]:
    """(text, language) of a bounded, repeatable sample outside the held-out fold, alike from each language; whole texts
    that have a letter. Rows without language are left out, a null key is a key; a key counts once for a language,
    however many rows repeat it, with the smallest of its texts. Without a language there is no sample."""
    known = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("y")).filter("y IS NOT NULL").filter(id_remainder(F.col("k"), modulus) != held).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return []
    each = max(1, SAMPLE_DOCUMENTS // len(counts))
    # A first cut by hash leaves about three times each language's share, whatever its size; then the lowest hashes.
    share = F.create_map(*[x for y, c in sorted(counts.items()) for x in (F.lit(y), F.lit(min(1.0, 3 * each / c)))])
    order = sample_order(F.col("k"), 31)
    near = known.filter(F.pmod(order, F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(order, "k"))).filter(F.col("r") <= each).select("k", "y")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("y")).join(F.broadcast(chosen), ["k", "y"])
    # One row per key and language before anything is gathered, however often they repeat.
    found = rows.filter("t IS NOT NULL").groupBy("k", "y").agg(F.min("t").alias("t")).select("t", "y").collect()
    return sorted((r["t"], r["y"]) for r in found if _letter(r["t"]))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> tuple[BiGRU | None, list[str]]:
    """The network and its languages by code point; no network where no row has a language and a letter."""
    sample = sample_texts(docs, text, key, lang)
    names = sorted({y for _, y in sample})
    if not names:
        return None, []
    model, index = BiGRU(len(names)), {y: i for i, y in enumerate(names)}
    sequences, labels = [], []
    for t, y in sample:
        raw = t.lower().encode()
        for at in range(0, len(raw), SEQUENCE):
            # Some begin as a text does, between spaces; most in its midst.
            sequences.append(b" " + raw[at : at + SEQUENCE] + b" " if at == 0 else raw[at - 1 : at + SEQUENCE + 1])
            labels.append(index[y])
    model.train(sequences, np.array(labels))
    return model, names


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", modulus: int = 3, held: int = 1) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row: the language with the highest mean probability, and that mean.

    und with score 0 where the text is null or has no letter, or where no row has a language. Of probabilities that are
    equal to four places the first language by code point wins. Texts are read whole, however long; equal texts are
    labelled alike, repeated rows give repeated results, an empty table none. Other columns of docs are ignored,
    whatever their names.
    """
    model, names = fit(docs, text, key, lang)
    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def label(texts: list[str | None]) -> list[tuple[str, float]]:
        # Each different text once, in a fixed order.
        read = sorted({t for t in texts if t and names and _letter(t)})
        told = {}
        if read:
            # Rounded, so that the size of a batch can't show.
            for t, mean in zip(read, np.round(model.probabilities(read), 4)):
                best = int(mean.argmax())
                told[t] = (names[best], float(mean[best]))
        return [told.get(t, (UNKNOWN, 0.0)) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_CHARS):
                found = label(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([y for y, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["k", "lang_pred", "score"])
        let_go()

    out = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("k").alias(key), (id_remainder(F.col("k"), modulus) == held).alias("held_out"), "lang_pred", "score")
