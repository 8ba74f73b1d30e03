"""Secret scans with corpus-wide ownership, in built-in expressions only.

Spans come from patterns; their places are sums of the lengths of the pieces between matches. The value of each
candidate is hashed and counted over the whole corpus by distinct repositories (documents) and owners (sources): a
value that many owners hold is a widely copied example, one that a single owner holds and that looks random is live.
Base kinds (assign, access, hex) always count as spans. The method adds spans of further kinds, each only where
ownership says that it is live.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import cut, join_hot


#: Elements that a running value goes over at once, so that its cost is in proportion to an array's length.
BLOCK = 256


def _either_case(letters: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in letters)


_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: Kind, pattern, the group that holds the secret, and how many characters that group needs.
BASE = (
    ("assign", f"""({_WORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Kinds the method adds: prefixed service tokens, signed web tokens, and long mixed strings.
ADDED = (
    ("service", "(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("webtoken", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("mixed", "[A-Za-z0-9+/_=-]{24,}", 0, 24),
)
#: What a mixed string needs besides: its characters up to padding, and one of each sort.
MIXED = ("^[A-Za-z0-9+/_-]{24,}={0,2}$", "[0-9]", "[a-z]", "[A-Z]")
#: A value held by this many owners, or this many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 8
#: A value looks live if at least this share of its characters are different ones.
VARIETY = 0.3


def find_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>>: matches leftmost first, in code points, end exclusive. A null or empty text
    has none; a text is searched whole, however long."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    pieces = F.split(text, pattern)
    pairs = F.arrays_zip(pieces.alias("piece"), match.alias("match"), value.alias("value"))
    whole = F.filter(pairs, lambda p: p["match"].isNotNull())
    if kind == "mixed":
        fits = lambda v: reduce(lambda a, b: a & b, [v.rlike(m) for m in MIXED])
        keep = lambda v: (F.length(v) >= least) & fits(v)
    else:
        keep = lambda v: F.length(v) >= least
    # Lengths add up from the left: each match starts where the pieces and matches before it end.
    lengths = F.transform(whole, lambda p: F.struct(F.length(p["piece"]).alias("gap"), F.length(p["match"]).alias("own")))

    def placed(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda z: z["gap"] + z["own"]), lambda a, b: a + b)
        return F.zip_with(whole, F.zip_with(before, sizes, lambda a, z: F.struct((a + z["gap"]).alias("start"), (a + z["gap"] + z["own"]).alias("end"))), lambda p, at: F.struct(at["start"].alias("start"), F.lit(kind).alias("kind"), at["end"].alias("end"), p["value"].alias("value")))

    none = F.array().cast("array<struct<start:int,kind:string,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(_let(lengths, placed), lambda p: keep(p["value"]))).otherwise(none)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of int, the join of all before it, 0 for the first. Blocks are joined first, and
    then each from its own start: appending to one long array would copy it for each element."""

    def walk(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, v: F.struct(join(s["now"], v).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    def blocks(array: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(array) - 1) / size).cast("int")), lambda i: F.slice(array, i * size + 1, size))

    def over(cut: Column) -> Column:
        totals = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), join))
        firsts = _let(totals, lambda t: walk(t, F.lit(0)))
        return F.flatten(F.zip_with(cut, firsts, walk))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(values, lambda v: _let(blocks(v, BLOCK), over)))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. Both are put in order, the others by start and the spans by end; the
    furthest end that comes before a span's is then that of an other one which starts before the span ends."""
    shape = "array<struct<at:int,other:int,start:int,kind:string,end:int,value:string>>"
    mine = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    theirs = F.transform(others, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("other"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    def judged(order: Column) -> Column:
        reach = running(F.transform(order, lambda s: F.when(s["other"] == 1, s["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.zip_with(order, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: (x["s"]["other"] == 0) & (x["r"] <= x["s"]["start"]))
        return F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value")))

    # Without spans, or without others, nothing is to be judged.
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(_let(F.array_sort(F.concat(mine, theirs).cast(shape)), judged))


def _rank(kind: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*BASE, *ADDED)])
    return F.array_position(names, kind)


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, repositories, owners) of candidates (secret, repository, owner). Distinct pairs first, so a value that
    fills a third of the rows is counted where it is read; a null repository or owner counts as one of its own. An empty
    table gives an empty one."""
    repos = candidates.select("secret", "repository").distinct().groupBy("secret").agg(F.count("*").alias("repositories"))
    owners = candidates.select("secret", "owner").distinct().groupBy("secret").agg(F.count("*").alias("owners"))
    return repos.join(owners, "secret")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of docs: counts of base kinds, base_sha256, spans, n_live and n_example over all candidates.

    A null or empty text has no spans; base_sha256 is then that of the empty text. Rows that share a key count as one
    repository, a null owner is an owner, and equal texts have equal base spans; an added span counts where its value
    has one owner. Texts are read whole, and the work on a text is in proportion to its length and matches. An empty
    table gives an empty one; other columns of docs are ignored, whatever their names.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner}`").alias("owner"), *[find_spans(t, *k).alias(k[0]) for k in (*BASE, *ADDED)])
    base = F.concat(*[F.col(k[0]) for k in BASE])
    # A span of an added kind that overlaps one of a kind before it is that span already.
    taken, added = base, []
    for kind, *_ in ADDED:
        added.append(apart(F.col(kind), taken))
        taken = F.concat(taken, F.col(kind))
    outside = F.concat(*added)
    found = found.select("key", "owner", F.monotonically_increasing_id().alias("row"), base.alias("base"), outside.alias("added"))
    # Written, so a row's number is the same for all that reads it.
    found = cut(found, "secret-spans")
    spread = found.select("row", "key", "owner", F.explode(F.concat("base", "added")).alias("s"))
    candidates = spread.select("row", F.col("key").alias("repository"), "owner", F.xxhash64("s.value").alias("secret"), "s.start", "s.kind", "s.end", (F.size(F.array_distinct(F.split("s.value", ""))) >= F.length("s.value") * VARIETY).alias("varied"))
    # A widely copied value is dealt over many tasks.
    known = join_hot(candidates, ownership(candidates), "secret", F.col("row"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    known = known.withColumn("live", ~example & F.col("varied"))
    live = known.groupBy("row").agg(F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(example.cast("long")).alias("n_example"), F.collect_list(F.when(F.col("live") & ~F.col("kind").isin(*[k[0] for k in BASE]), F.struct("start", "kind", "end"))).alias("more"))
    out = found.join(live, "row", "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,kind:string,end:int>>"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("key").alias(key), *[count(k[0]) for k in BASE], F.sha2(_joined(plain).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(plain, more)).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def _sql() -> str:
    """The same in SQL, over the table documents."""
    kinds = [*BASE, *ADDED]
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    raw = " UNION ALL ".join(f"SELECT row, '{k}' AS kind, {i} AS rank, {n} AS least, regexp_split_to_array(t, {quote(p)}) AS p, regexp_extract_all(t, {quote(p)}, 0) AS m, regexp_extract_all(t, {quote(p)}, {g}) AS v FROM d WHERE regexp_matches(t, {quote(p)})" for i, (k, p, g, n) in enumerate(kinds))
    mixed = " AND ".join(f"regexp_matches(v, {quote(m)})" for m in MIXED)
    spelled = "string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (SELECT row, kind, rank, least, m[i] AS m, v[i] AS v, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM each),
spans AS (SELECT row, kind, rank, start, start + length(m) AS fin, v FROM placed WHERE length(v) >= least AND (kind <> 'mixed' OR ({mixed}))),
kept AS (SELECT * FROM spans a WHERE rank < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.row = a.row AND b.rank < greatest(a.rank, {len(BASE)}) AND a.start < b.fin AND b.start < a.fin)),
held AS (SELECT v, count(DISTINCT coalesce(doc_id::VARCHAR, '-')) AS repositories, count(DISTINCT coalesce('=' || source, '-')) AS owners FROM kept JOIN d USING (row) GROUP BY v),
judged AS (SELECT kept.*, owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} AS example, len(list_distinct(string_split(v, ''))) >= length(v) * {VARIETY}::DOUBLE AS varied FROM kept JOIN held USING (v)),
told AS (SELECT row, {counts}, {spelled} FILTER (rank < {len(BASE)}) AS base, {spelled} FILTER (rank < {len(BASE)} OR (NOT example AND varied)) AS spans, count(*) FILTER (NOT example AND varied) AS n_live, count(*) FILTER (example) AS n_example FROM judged GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN told USING (row)"""


ORACLE = _sql()
