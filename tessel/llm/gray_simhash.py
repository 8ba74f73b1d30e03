"""SimHash near-duplicates by a hierarchical index in Gray order.

A table of the index has leading bits; fingerprints stand in it in the Gray order of those bits and then in the Gray
order of all, where neighbours share long masked patterns. Over them stands a hierarchy of nodes: a node holds the bits
that all its members share and that its parent doesn't hold already. A search adds up differing bits from the root down
and leaves whole groups as soon as the sum is over DISTANCE, once a leading bit differs, or once all of a group is known
to be linked to the searcher. Every link comes out of such a search, whatever the size of a group. Fingerprints within
DISTANCE bits agree in at least two of six blocks of bits, so fifteen tables, each led by two blocks, find all pairs. A
table is dealt over tasks by its leading bits. Only a spanning forest of the links leaves a task, never all pairs of a
group. Leading bits that more than HOT fingerprints share are led by further bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from tessel.llm.components import connected
from tessel.llm.shared import by_place, cut, join_hot, let_go, maybe_in, shuffle_width

WORDS = 4
DISTANCE = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of a node of the hierarchy.
FAN = 8
#: Fingerprints with the same leading bits above which these are led by one of five parts of their other bits too, at
#: most DEEPER times; then 42 bits or more lead, and a task holds 4 million different fingerprints at most.
HOT, DEEPER = 20_000, 3
#: Fingerprints that a task gathers for one search of its tables, and places of the hierarchy that a step looks at.
TOGETHER, LOOKED_AT = 1 << 17, 1 << 19
_U = np.uint64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles; zero without words."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: Column | None = None) -> DataFrame:
    """(key, fp), and _mark if there is one, a string: fp is the fingerprint as a signed long."""
    more = [] if mark is None else ["_mark"]
    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), *[mark.alias(m) for m in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([fingerprint(t) for t in part.column("t").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(fp), *map(part.column, more)], ["k", "fp", *more])
        let_go()

    schema = ", ".join([f"k {source.schema['k'].dataType.simpleString()}", "fp long", *[f"{m} string" for m in more]])
    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(widths: tuple[int, ...] = BLOCKS) -> list[int]:
    """The bits of each pair of blocks."""
    blocks, at = [], 0
    for w in widths:
        blocks.append(((1 << w) - 1) << at)
        at += w
    return [a | b for a, b in combinations(blocks, 2)]


def deeper_masks(mask: int) -> list[int]:
    """mask with one of DISTANCE + 1 parts of the other bits: two fingerprints that agree on mask agree on one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[j :: DISTANCE + 1] for j in range(DISTANCE + 1)]
    return [mask | sum(1 << i for i in p) for p in parts]


def gray_rank(fp: Column) -> Column:
    """Rank of a code in the reflected Gray sequence, shifted so that signed longs sort in its order."""
    g = fp
    for s in (1, 2, 4, 8, 16, 32):
        g = g.bitwiseXOR(F.shiftrightunsigned(g, s))
    return g.bitwiseXOR(F.lit(-(1 << 63)))


def gray_code(rank: np.ndarray) -> np.ndarray:
    r = rank.view(np.uint64) ^ _U(1 << 63)
    return r ^ (r >> _U(1))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of edges u, v that aren't their component's smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


class GrayIndex:
    """The hierarchy over one table's fingerprints, which come in the table's order. leading: bits that have to agree."""

    def __init__(self, codes: np.ndarray, leading: int = 0):
        self.codes, self.leading = codes, _U(leading)
        self.searches, self.compared = 0, 0
        levels = []  # from the leaves' parents to the root: shared bits, their values, first member of each node
        low, high, first = codes, codes, np.arange(len(codes))
        while len(first) > 1:
            at = np.arange(0, len(first), FAN)
            low, high, first = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at), first[at]
            levels.append((~(low ^ high), low, first))
        self.levels = levels[::-1]
        self.own = []  # bits that a node adds to its parent's
        for i, (shared, _, _) in enumerate(self.levels):
            above = self.levels[i - 1][0][np.arange(len(shared)) // FAN] if i else np.zeros(1, np.uint64)
            self.own.append(shared & ~above)

    def _search(self, start: int, stop: int, root: np.ndarray, spans: list, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Links of members start to stop with later members; None if the step would look at too many places."""
        codes, n = self.codes, len(self.codes)
        q, node, diff = np.arange(start, stop), np.zeros(stop - start, np.int64), np.zeros(stop - start, np.int64)
        for depth, ((_, value, first), own, (last, low, high)) in enumerate(zip(self.levels, self.own, spans)):
            if depth:
                q, node, diff = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(diff, FAN)
                there = node < len(first)
                q, node, diff = q[there], node[there], diff[there]
            # Members after the searcher only; and none of a group that is linked to it as a whole.
            stay = (last[node] > q + 1) & ~((low[node] == root[q]) & (high[node] == root[q]))
            q, node, diff = q[stay], node[stay], diff[stay]
            self.compared += len(q)
            apart = (codes[q] ^ value[node]) & own[node]
            diff = diff + np.bitwise_count(apart).astype(np.int64)
            stay = (diff <= limit) & (apart & self.leading == 0)
            q, node, diff = q[stay], node[stay], diff[stay]
            if len(q) * FAN > LOOKED_AT and stop - start > 1:
                return None
        member = (node[:, None] * FAN + np.arange(FAN)).ravel()
        q = np.repeat(q, FAN)
        stay = (member < n) & (member > q)
        q, member = q[stay], member[stay]
        self.compared += len(q)
        apart = codes[q] ^ codes[member]
        near = (root[q] != root[member]) & (np.bitwise_count(apart) <= limit) & (apart & self.leading == 0)
        return q[near], member[near]

    def links(self, limit: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of the links between members, as positions."""
        n = len(self.codes)
        root = np.arange(n)
        out_u, out_v = [], []
        start, width, spans = 0, 16, None
        while start < n - 1:
            if spans is None:  # where each node's members end, and the least and greatest of their roots
                spans = [(np.append(first[1:], n), np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)) for _, _, first in self.levels]
            stop = min(n, start + width)
            self.searches += stop - start
            found = self._search(start, stop, root, spans, limit)
            if found is None:
                width = max(1, width // 8)
                continue
            if len(found[0]):
                u, v = forest(root[found[0]], root[found[1]])
                out_u.append(u)
                out_v.append(v)
                jump = np.arange(n)
                jump[u] = v
                root, spans = jump[root], None
            start, width = stop, min(8192, width * 2)
        return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def linked(mask: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges, as fingerprints, of rows sorted by their tables' masks and then in the tables' order."""
    codes, us, vs = gray_code(rank), [], []
    edges = np.concatenate([[0], np.flatnonzero(mask[1:] != mask[:-1]) + 1, [len(mask)]])
    for a, b in zip(edges[:-1], edges[1:]):
        own = codes[a:b]
        u, v = GrayIndex(own, int(mask[a]) & (1 << 64) - 1).links()
        us.append(own[u])
        vs.append(own[v])
    u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
    return forest(u, v) if len(u) else (u, v)


def _find_links(led: DataFrame, width: int) -> DataFrame:
    dealt = led.repartition(width, "mask", "lead").sortWithinPartitions("mask", "lead", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, ("mask", "lead", "rank"))]
            if len(held[0]) < TOGETHER:
                continue
            # Whole groups of leading bits only; the last one may go on in the next batch.
            ends = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            done = ends[-1] + 1 if len(ends) else 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked(held[0][:done], held[2][:done])], ["u", "v"])
                held = [h[done:] for h in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked(held[0], held[2])], ["u", "v"])
        let_go()

    return dealt.mapInArrow(run, "u long, v long")


def _led(codes: DataFrame, masks: Column) -> DataFrame:
    """(mask, lead, rank, fp): each code in each table, by the Gray rank of its leading bits and that of all."""
    spread = codes.select(F.explode(masks).alias("mask"), "rank", "fp")
    return spread.select("mask", gray_rank(F.col("fp").bitwiseAND(F.col("mask"))).alias("lead"), "rank", "fp")


def links(codes: DataFrame) -> DataFrame:
    """Forest edges (u, v) whose components are those of all pairs of codes (fp long, distinct) within DISTANCE bits."""
    width = shuffle_width(codes.sparkSession)
    several = lambda ms: F.array(*[F.lit(_signed(m)) for m in ms])
    masks, found = block_masks(), None
    led = _led(codes.select("fp", gray_rank(F.col("fp")).alias("rank")), several(masks))
    for depth in range(DEEPER + 1):
        hot = cut(led.groupBy("mask", "lead").count().filter(F.col("count") > HOT).select("mask", "lead"), "hot-leads") if depth < DEEPER else None
        many = hot is not None and not hot.isEmpty()
        part = _find_links(led.join(hot, ["mask", "lead"], "left_anti") if many else led, width)
        found = part if found is None else found.union(part)
        if not many:
            break
        below = {m: deeper_masks(m) for m in masks}
        further = F.create_map(*[x for m, ms in below.items() for x in (F.lit(_signed(m)), several(ms))])
        led = _led(led.join(hot, ["mask", "lead"]), further[F.col("mask")])
        masks = sorted({d for ms in below.values() for d in ms})
    return found


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): the smallest key reachable over links, itself included.

    A null or empty text, or one without words, has fingerprint zero, which links like any other. Rows that share a key
    are rows of one document; a null key keeps its row, and its component's smallest key is null only if all are.
    Texts are read whole, however long; repeated rows give repeated results, an empty table gives none. Other columns
    of docs are ignored, whatever their names.
    """
    own = cut(fingerprints(docs, text, key), "fingerprints")
    named = _least_of_component(own, F.col(key)).withColumnRenamed("least", "component_id")
    joined = join_hot(own.withColumnRenamed(key, "k"), named, "fp", F.col("k"))
    return joined.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _least_of_component(own: DataFrame, value: Column) -> DataFrame:
    """(fp, least): for each fingerprint of own the smallest value in its component."""
    codes = cut(own.groupBy("fp").agg(F.min(value).alias("least")), "codes")
    roots = connected(links(codes.select("fp")))
    grouped = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("least"))
    return join_hot(grouped.select("fp", "root"), smallest, "root", F.col("fp")).select("fp", "least")


def _row_mark(docs: DataFrame) -> Column:
    """A digest of 128 bits of a row's plain columns; rows with the same digest are equal in all of them."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    # A null leaves the hash as it was, so the hash is told where nulls are.
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(n), *plain, *[c.isNull() for c in plain])), 16, "0") for n in (0, 1)])


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: one of each component, the one with the smallest key. Columns and texts as they are.

    A component keeps one row whatever its rows' keys: of rows without key, or that share a key, each component's own
    stays. A null key comes after all others; of a component's rows with the same key the smallest digest stays, so the
    choice rests on the rows alone. Rows equal throughout are one component. Texts without words form one component.
    Texts are read whole, however long; an empty table gives an empty one; columns may have any names.
    """
    rows, (t, k) = by_place(docs, text, key)
    rows = rows.withColumn("_mark", _row_mark(rows))
    own = cut(fingerprints(rows, t, k, F.col("_mark")), "fingerprints")
    best = _least_of_component(own, F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key"), "_mark"))
    found = join_hot(own, best, "fp", F.col("_mark")).select("_mark", (F.col("_mark") == F.col("least")["_mark"]).alias("stays"))
    # Rows that go, or that stand several times; all other rows stay without a shuffle.
    touched = cut(found.groupBy("_mark").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).filter("NOT stays OR n > 1").select("_mark", "stays"), "touched-rows")
    marked = maybe_in(rows, touched, "_mark", "_touched")
    judged = marked.filter("_touched").dropDuplicates(["_mark"]).join(touched, "_mark", "left").filter("stays IS NULL OR stays")
    kept = judged.drop("_mark", "_touched", "stays").union(marked.filter("NOT _touched").drop("_mark", "_touched"))
    return kept.toDF(*docs.columns)
