"""Merge-type SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs.

The text is normalised the way the model states (identity, a leading U+2581, spaces as U+2581), cut where no piece
can cross, and each segment is merged by an agenda: the adjacent pair whose union has the best score goes first, the
leftmost among equals. Symbols without a piece fall back to bytes. Each worker keeps the segments it has merged, up to
MEMO_SEGMENTS. Every newly merged segment is held against the sentencepiece library; the agenda's ids stand either way,
and a row says how many of its segments the library splits otherwise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import let_go, text_slices

SPACE = "▁"
#: Segments in each of the two generations a worker remembers. It bounds memory, not results.
MEMO_SEGMENTS = 120_000
#: Segments longer than this are merged each time they occur and not remembered.
MEMO_CHARS = 64
#: Characters up to which segments merge together in arrays; a longer segment has a heap of its own.
SHORT = 40
#: Characters of text encoded at once in a worker.
SLICE_CHARS = 1 << 17
#: Short segments merged together; their arrays stay in the processor's cache.
TOGETHER = 4096
#: Segments that one call of the library checks as one text of lines.
CHECKED = 32
HASH_BITS, HASH_ODD = 18, -7046029254386353131

_OUT = ["n_tokens", "ids_sha256", "decoded_sha256", "unlike_library"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Agenda encoder for a merge-type model with byte fallback."""

    def __init__(self, model_file: str, check: bool = True):
        import numpy as np
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and spec.byte_fallback) or spec.treat_whitespace_as_suffix or 4 in kinds or 5 in kinds:
            raise ValueError("this encoder needs a merge-type model with identity normalisation, a leading space and byte fallback")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.check = check
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        longer = [p for p in self.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece has a space after another character")
        joined = {c for p in longer for c in p}
        #: White space that no piece joins to a neighbour cuts segments too.
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)
        if "\n" not in self.alone:
            raise ValueError("a piece joins a newline to another character")
        cut = re.escape(self.alone)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + f"|[{cut}]").findall
        self.size = len(proto.pieces)
        self._pair_table()
        self.ints = list(range(self.size))  # shared, so that remembered ids take no objects of their own
        self.decimal = list(map(str, self.ints))
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, (i, _) in self.pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.memos: dict[str, tuple[dict, dict]] = {"plain": ({}, {}), "other": ({}, {})}
        self.unlike: set[str] = set()

    def _pair_table(self) -> None:
        """Each split of a piece into two pieces, with the union's id and score, in a hash table of arrays."""
        import numpy as np

        rows = {}
        for piece, (i, score) in self.pieces.items():
            for at in range(1, len(piece)):
                if (left := self.pieces.get(piece[:at])) and (right := self.pieces.get(piece[at:])):
                    rows[left[0] * self.size + right[0]] = (i, score)
        #: Chained hashing: slots points at the first key of a slot, after at the next key of the same slot; key 0 is no pair.
        self.keys = np.array([-1, *sorted(rows)], np.int64)
        self.pair_id = np.array([0, *[rows[k][0] for k in self.keys[1:].tolist()]], np.int32)
        self.pair_score = np.array([0, *[rows[k][1] for k in self.keys[1:].tolist()]], np.float32)
        if len(set(self.pair_score[1:].tolist())) < len({rows[k][1] for k in rows}):
            raise ValueError("scores need more than single precision")
        self.slots, self.after, depth = np.zeros(1 << HASH_BITS, np.int32), np.zeros(len(self.keys), np.int32), {}
        slot = ((self.keys * HASH_ODD).view(np.uint64) >> np.uint64(64 - HASH_BITS)).tolist()
        for i in range(1, len(self.keys)):
            self.after[i], self.slots[slot[i]] = self.slots[slot[i]], i
            depth[slot[i]] = depth.get(slot[i], 0) + 1
        self.probes = max(depth.values()) - 1

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, TOGETHER segments at a time."""
        return [ids for at in range(0, len(segments), TOGETHER) for ids in self._merge_together(segments[at : at + TOGETHER])]

    def _merge_together(self, segments: list[str]) -> list[list[int]]:
        """All segments advance together: each round takes the head of every segment's agenda."""
        import numpy as np

        out: list[list[int] | None] = [None] * len(segments)
        short = [i for i, s in enumerate(segments) if len(s) <= SHORT]
        chars = np.frombuffer("".join([segments[i] for i in short]).encode("utf-32-le"), np.uint32)
        sym = self.of_char[chars]
        seg = np.repeat(np.arange(len(short), dtype=np.int32), [len(segments[i]) for i in short])
        unknown = np.zeros(len(short), bool)
        unknown[seg[sym < 0]] = True
        done_seg, done_sym = [], []
        stays = ~unknown[seg]
        sym, seg = sym[stays], seg[stays]

        def scores(left, right, same):
            key = left.astype(np.int64) * self.size + right
            at = self.slots[(key * HASH_ODD).view(np.uint64) >> np.uint64(64 - HASH_BITS)]
            hit = self.keys[at] == key
            for _ in range(self.probes):
                if hit.all():
                    break
                at = np.where(hit, at, self.after[at])
                hit = self.keys[at] == key
            return np.where(hit & same, self.pair_score[at], np.float32(-np.inf)), self.pair_id[at]

        if len(sym):
            same = np.append(seg[:-1] == seg[1:], False)
            value, union = scores(sym, np.roll(sym, -1), same)
            while len(sym):
                starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                best = np.maximum.reduceat(value, starts)
                rank = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(seg))))
                over = (best == -np.inf)[rank]
                if over.any():
                    done_seg.append(seg[over])
                    done_sym.append(sym[over])
                    keep = ~over
                    sym, seg, value, union, rank = sym[keep], seg[keep], value[keep], union[keep], rank[keep]
                    if not len(sym):
                        break
                heads = np.flatnonzero(value == best[rank])
                heads = heads[np.append(True, rank[heads][1:] != rank[heads][:-1])]
                sym[heads] = union[heads]
                keep = np.ones(len(sym), bool)
                keep[heads + 1] = False
                shifted = np.cumsum(keep) - 1
                sym, seg, value, union = sym[keep], seg[keep], value[keep], union[keep]
                here = shifted[heads]
                # The pair that starts at a merged symbol and the pair that ends there are scored anew.
                for at in (here, here[here > 0] - 1):
                    after = np.minimum(at + 1, len(sym) - 1)
                    value[at], union[at] = scores(sym[at], sym[after], (after > at) & (seg[at] == seg[after]))
            order = np.argsort(np.concatenate(done_seg), kind="stable")
            flat, owner = np.concatenate(done_sym)[order].tolist(), np.concatenate(done_seg)[order]
            ends = np.searchsorted(owner, np.arange(len(short)), "right").tolist()
            at = 0
            for i, end in zip(short, ends):
                out[i] = flat[at:end]
                at = end
        for i in range(len(segments)):
            if not out[i]:
                out[i] = self.merge(segments[i])
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, by an agenda kept as a heap."""
        ids: list[int] = []
        for s in self._merge_long(segment):
            if (found := self.pieces.get(s)) is not None:
                ids.append(found[0])
            else:
                ids.extend(self.bytes[b] for b in s.encode())
        return ids

    def _merge_long(self, segment: str) -> list[str]:
        pieces, symbols = self.pieces, list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (p := pieces.get(both := symbols[left] + symbols[right])):
                heapq.heappush(agenda, (-p[1], left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            # Stale where either symbol has been merged since; a merged-away symbol is empty.
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _checked(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of each segment. A segment that the library splits otherwise is put down in unlike."""
        own, ints = self.merge_many(segments), self.ints
        if self.check:
            # Lines of several segments: the newlines keep each apart, and the library's own leading space is dropped.
            line, skip = self.library.encode("\n")[-1], len(self.library.encode("\n"))
            groups = range(0, len(segments), CHECKED)
            told = self.library.encode(["\n" + "\n".join(segments[at : at + CHECKED]) for at in groups], num_threads=1)
            for at, ids in zip(groups, told):
                flat = []
                for x in own[at : at + CHECKED]:
                    flat += x
                    flat.append(line)
                if flat[:-1] != ids[skip:]:
                    self.unlike |= {s for s, x in zip(segments[at : at + CHECKED], own[at : at + CHECKED]) if x != self.library.encode("\n" + s)[skip:]}
        return [tuple([ints[i] for i in ids]) for ids in own]

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], str, int]]:
        """Per text: its ids, the same ids in decimal, joined by commas, and its segments that the library splits otherwise.

        Most texts have single spaces only; they are split at spaces and before newlines, and the key of a segment is
        the word, or the newline with the word after it. Other texts are cut by the pattern, keyed by segment.
        """
        out: list[tuple[list[int], str, int] | None] = [None] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = ([], "", 0)
                continue
            spread = t.replace("\n", " \n")
            if SPACE in t or "  " in spread or spread[0] == " " or spread[-1] == " ":
                other.append((i, self.segments(SPACE + t.replace(" ", SPACE))))
            else:
                plain.append((i, spread.split(" ")))
        self._look_up(plain, "plain", out)
        self._look_up(other, "other", out)
        return out

    def _look_up(self, cut: list[tuple[int, list[str]]], kind: str, out: list) -> None:
        if not cut:
            return
        (memo, older), decimal = self.memos[kind], self.decimal
        used = set().union(*[c for _, c in cut])
        new = []
        for s in used.difference(memo):
            if (known := older.get(s)) is not None:
                memo[s] = known
            else:
                new.append(s)
        if kind == "other":
            memo.update(zip(new, self._checked(new)))
        elif new:
            # A key with a newline stands for that newline's ids and those of the rest, which has no leading space.
            lines = [s for s in new if s[0] == "\n" and len(s) > 1]
            words = [s for s in new if s[0] != "\n"]
            found = self._checked([SPACE + s for s in words] + [s[1:] for s in lines])
            line = self.library.encode("\n")[-1]
            memo.update(zip(words, found))
            memo.update({s: (line, *ids) for s, ids in zip(lines, found[len(words) :])})
            memo["\n"] = (line,)
        for i, segments in cut:
            ids = list(chain.from_iterable([memo[s] for s in segments]))
            unlike = sum((s if kind == "other" else s[1:] if s[0] == "\n" else SPACE + s) in self.unlike for s in segments) if self.unlike else 0
            out[i] = (ids, ",".join([decimal[x] for x in ids]), unlike)
        for s in [s for s in new if len(s) > MEMO_CHARS]:
            del memo[s]
        if len(memo) > MEMO_SEGMENTS:
            self.memos[kind] = ({}, memo)


def encode_documents(docs: DataFrame, model_file: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode the whole text of each row; return the columns of keep with n_tokens, ids_sha256, decoded_sha256 and
    unlike_library, the number of segments that the library splits otherwise: 0, or the encoder is at fault.

    with_ids adds ids (array of int) and decoded (string). A null text counts as empty: no ids, empty decoded text. A
    text is encoded whole, however long. Repeated rows give repeated results, an empty table none; other columns of docs
    are ignored, whatever their names.
    """
    model = model_file or default_model()
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    extra = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    schema = extra + "n_tokens long, ids_sha256 string, decoded_sha256 string, unlike_library long" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_CHARS):
                coded = encoder.encode_batch(part.column("t").to_pylist())
                decoded = [encoder.library.decode(ids) if ids else "" for ids, _, _ in coded]
                columns = [part.column(n) for n in names] + [pa.array([len(i) for i, _, _ in coded], pa.int64()), pa.array([sha(s) for _, s, _ in coded]), pa.array([sha(d) for d in decoded]), pa.array([u for _, _, u in coded], pa.int64())]
                labels = [*names, *_OUT]
                if with_ids:
                    columns += [pa.array([i for i, _, _ in coded], pa.list_(pa.int32())), pa.array(decoded)]
                    labels += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, labels)
        del encoder
        let_go()

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[c for c in out.columns if c not in names])
