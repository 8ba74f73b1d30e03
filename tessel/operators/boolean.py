"""Boolean retrieval: the query language, and its compilation into one predicate over term flags.

A query is read once on the driver and becomes a Column; a search scans the postings of its terms once, turns them into
flags per document with one aggregate, and filters, whatever the size of the query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import DEFAULT, TokenOptions, query_terms

AND, OR, NOT, OPEN, CLOSE, TERM = "AND", "OR", "NOT", "(", ")", "TERM"
_BINDING = {NOT: 3, AND: 2, OR: 1}
_SPACE = " \t\n\v\f\r"
PAGE = 50


class QueryError(ValueError):
    """A query that isn't well formed."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str = ""


def lex(query: str) -> list[Token]:
    """Words, and/or/not in any ASCII case, ! && || and parentheses; a single & or | belongs to a word."""
    signs = {"&&": AND, "||": OR, "!": NOT, "(": OPEN, ")": CLOSE}
    words = {"and": AND, "or": OR, "not": NOT}
    out: list[Token] = []
    word = ""

    def close() -> None:
        nonlocal word
        if word:
            kind = words.get("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in word))
            out.append(Token(kind, word) if kind else Token(TERM, word))
            word = ""

    at = 0
    while at < len(query):
        sign = next((s for s in signs if query.startswith(s, at)), None)
        if sign:
            close()
            out.append(Token(signs[sign], sign))
            at += len(sign)
            continue
        if query[at] in _SPACE:
            close()
        else:
            word += query[at]
        at += 1
    close()
    return out


def to_rpn(tokens: list[Token]) -> list[Token]:
    """Postfix order: NOT binds before AND before OR; AND and OR group from the left, NOT from the right."""
    out: list[Token] = []
    waiting: list[Token] = []
    for t in tokens:
        if t.kind == TERM:
            out.append(t)
        elif t.kind == OPEN:
            waiting.append(t)
        elif t.kind == CLOSE:
            while waiting and waiting[-1].kind != OPEN:
                out.append(waiting.pop())
            if not waiting:
                raise QueryError("mismatched parentheses")
            waiting.pop()
        else:
            mine = _BINDING[t.kind] + (t.kind == NOT)
            while waiting and waiting[-1].kind != OPEN and _BINDING[waiting[-1].kind] >= mine:
                out.append(waiting.pop())
            waiting.append(t)
    while waiting:
        if waiting[-1].kind == OPEN:
            raise QueryError("mismatched parentheses")
        out.append(waiting.pop())
    return out


def is_boolean(tokens: list[Token]) -> bool:
    """Whether a query has any operator or parenthesis."""
    return any(t.kind != TERM for t in tokens)


def fold_rpn(rpn: list[Token], leaf, both, either, negate):
    """Evaluate postfix tokens over any algebra; arity alone makes a query well formed."""
    stack: list = []
    for t in rpn:
        if t.kind == TERM:
            stack.append(leaf(t.text))
        elif t.kind == NOT:
            if not stack:
                raise QueryError("NOT has no operand")
            stack.append(negate(stack.pop()))
        else:
            if len(stack) < 2:
                raise QueryError(f"{t.kind} has too few operands")
            b, a = stack.pop(), stack.pop()
            stack.append(both(a, b) if t.kind == AND else either(a, b))
    if len(stack) != 1:
        raise QueryError(f"{len(stack)} results are left; operators are missing")
    return stack[0]


@dataclass(frozen=True)
class Compiled:
    """terms: those the query needs, sorted. predicate: over array flags, one per term."""

    terms: tuple[str, ...]
    rpn: tuple[Token, ...]
    options: TokenOptions

    def predicate(self, flag) -> Column:
        """flag(term) is the Column that says whether the document has the term."""
        def leaf(text: str) -> Column:
            pieces = query_terms(text, self.options)
            return reduce(lambda a, b: a & b, [flag(p) for p in pieces]) if pieces else F.lit(False)

        return fold_rpn(list(self.rpn), leaf, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)

    @property
    def matches_nothing(self) -> bool:
        """Whether a document without any of the terms satisfies the query."""
        return fold_rpn(list(self.rpn), lambda t: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def compile_query(query: str, options: TokenOptions = DEFAULT) -> Compiled:
    rpn = to_rpn(lex(query))
    fold_rpn(rpn, lambda t: True, lambda a, b: True, lambda a, b: True, lambda a: True)
    terms = sorted({p for t in rpn if t.kind == TERM for p in query_terms(t.text, options)})
    return Compiled(tuple(terms), tuple(rpn), options)


def boolean_search(posted: DataFrame, docs: DataFrame, query: str, options: TokenOptions = DEFAULT) -> DataFrame:
    """(doc_id) of the documents that satisfy the query. docs (doc_id) is the universe, read only if the query can
    hold for a document without any of its terms."""
    q = compile_query(query, options)
    name = {t: f"t{i}" for i, t in enumerate(q.terms)}
    scanned = posted.filter(F.col("term").isin(*q.terms)) if q.terms else posted.limit(0)
    flags = scanned.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(n) for t, n in name.items()], F.lit(True).alias("_seen"))
    if q.matches_nothing:
        flags = docs.select("doc_id").join(flags, "doc_id", "left")
        test = q.predicate(lambda t: F.coalesce(F.col(name[t]), F.lit(False)))
    else:
        test = q.predicate(lambda t: F.col(name[t]))
    return flags.filter(test).select("doc_id")


def page(hits: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    """One page by doc_id; a negative number is the first."""
    return hits.orderBy("doc_id").offset(max(0, number) * size).limit(size)


def with_metadata(hits: DataFrame, forward: DataFrame) -> DataFrame:
    """A few hits (after a limit) with their titles and URLs: the limited side is broadcast."""
    return forward.join(F.broadcast(hits), "doc_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.select(*a.columns).join(a, a.columns, "left_anti")


def boolean_batch(posted: DataFrame, docs: DataFrame, queries: list[tuple[int, str]], options: TokenOptions = DEFAULT, on_error: str = "raise") -> DataFrame:
    """(qid, doc_id) for a batch: one scan and one aggregate for all queries. on_error: raise, or skip bad queries."""
    compiled = []
    for qid, text in queries:
        if not text:
            continue
        try:
            compiled.append((qid, compile_query(text, options)))
        except QueryError:
            if on_error != "skip":
                raise
    terms = sorted({t for _, q in compiled for t in q.terms})
    if not compiled:
        return docs.select(F.lit(0).cast("long").alias("qid"), "doc_id").limit(0)
    name = {t: f"t{i}" for i, t in enumerate(terms)}
    scanned = posted.filter(F.col("term").isin(*terms)) if terms else posted.limit(0)
    flags = scanned.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(n) for t, n in name.items()], F.lit(True).alias("_seen"))
    if any(q.matches_nothing for _, q in compiled):
        flags = docs.select("doc_id").join(flags, "doc_id", "left")
    has = lambda t: F.coalesce(F.col(name[t]), F.lit(False))
    hits = F.array(*[F.when(q.predicate(has), F.lit(qid)) for qid, q in compiled])
    return flags.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("qid"), "doc_id").select(F.col("qid").cast("long").alias("qid"), "doc_id")
