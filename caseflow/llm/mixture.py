"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from caseflow.llm.common import WORD_CLASS, stored, text_of, unpacked, whole_rows

SEED = "mix-1"
#: How often a document may be used, and what a word costs on its first, second and third use.
USES = 3
USE_COSTS = (0, 1, 3)
_CELL_BITS = 12
_HASH_BITS = 60


def word_count(text: str = "text") -> Column:
    """Maximal runs of anything but white space; NULL has none."""
    return F.regexp_count(text_of(text), F.lit(WORD_CLASS)).cast("bigint")


def seeded_hash(name: str = "doc_id", seed: str = SEED) -> Column:
    """60 bits of an MD5 of the seed and the identifier."""
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(label.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def default_weights(sources: list[str | None]) -> dict[str | None, float]:
    """Weights 5, 2, 1, repeating, over the sources by code point, the missing one last."""
    named = sorted(s for s in sources if s is not None)
    order = named + ([None] if None in sources else [])
    return {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(order)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float]) -> dict[str | None, float]:
    """Each source's share of all words by weight, at most ``USES`` times its size; what is over goes to the others by weight."""
    total = float(sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (USES * sizes[s] / weights[s], s is None, s or ""))
    out, given, rest = {}, 0.0, float(sum(weights[s] for s in sizes))
    for i, s in enumerate(order):
        limit = float(USES * sizes[s])
        if weights[s] * ((total - given) / rest) >= limit:
            out[s] = limit
            given += limit
            rest -= weights[s]
        else:
            out |= {t: weights[t] * ((total - given) / rest) for t in order[i:]}
            break
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict[str | None, int]) -> list[dict]:
    """Words that each pattern gives to each of its sources, and least repetition.

    ``patterns`` pairs the sources that a kind of document belongs to with the words of such
    documents. Every pattern may be used ``USES`` times, each use dearer than the one before (convex,
    as parallel arcs); a source takes its quota at most. Cheapest paths are filled one after another.
    """
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    n = 2 + len(patterns) + len(names)
    graph: list[list[_Arc]] = [[] for _ in range(n)]

    def link(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    for i, (members, words) in enumerate(patterns):
        for cost in USE_COSTS[:USES]:
            link(0, 2 + i, words, cost)
        for s in members:
            link(2 + i, place[s], USES * words, 0)
    for s in names:
        link(place[s], 1, quotas[s], 0)
    while True:
        far, via, queue, queued = {0: 0}, {}, [0], {0}
        for a in queue:
            queued.discard(a)
            for k, arc in enumerate(graph[a]):
                if arc.room > 0 and far[a] + arc.cost < far.get(arc.to, 1 << 60):
                    far[arc.to], via[arc.to] = far[a] + arc.cost, (a, k)
                    if arc.to not in queued:
                        queue.append(arc.to)
                        queued.add(arc.to)
        if 1 not in far:
            break
        path, at = [], 1
        while at:
            a, k = via[at]
            path.append(graph[a][k])
            at = a
        push = min(arc.room for arc in path)
        for arc in path:
            arc.room -= push
            graph[arc.to][arc.back].room += push
    return [
        {s: graph[arc.to][arc.back].room for arc in graph[2 + i] for s in members if arc.to == place[s]}
        for i, (members, _) in enumerate(patterns)
    ]


_PLAN = T.StructType(
    [
        T.StructField("plan_key", T.StringType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("whole", T.LongType()),
        T.StructField("rest", T.LongType()),
    ]
)


def pattern_key(members: Column) -> Column:
    """A pattern's name: its sources in order, told apart from each other and from a missing one."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"})


def mixed(rows: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``rows`` with what the mix takes of each: target, source_size, taken beside the columns there.

    ``rows`` has doc_id, members (array of the sources a document belongs to), size (words) and
    hash (``seeded_hash``); a size of 0 takes nothing. Words of a pattern are used ``whole`` times,
    and the ``rest`` comes from documents in the order of their hash; the last of them may give only
    its first words, so the pattern's flow is met to the word. target and source_size are of the
    document's first source. Sources and patterns with their sums pass the driver, one short row a
    pattern, documents never do; Spark broadcasts the plan if it is small. The flow takes a time in proportion to
    patterns times arcs times paths, so some thousands of patterns are its limit.

    Documents are cut into ``2 ** 12`` cells by hash; only the cell in which a pattern's rest runs
    out is ordered document by document.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({"plan_key": pattern_key(F.col("members")), "cell": F.shiftright("hash", _HASH_BITS - _CELL_BITS)})
    found = keyed.groupBy("plan_key", F.array_sort(F.array_distinct("members")).alias("m")).agg(F.sum("size").alias("size")).collect()
    patterns = sorted(((r["plan_key"], tuple(r["m"]), int(r["size"])) for r in found), key=lambda x: x[0])
    sizes: dict[str | None, int] = {}
    for _, members, size in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    weights = default_weights(list(sizes)) if weights is None else weights
    wanted = targets({s: n for s, n in sizes.items() if n}, weights) if sum(sizes.values()) else {}
    flows = min_cost_flow([(m, n) for _, m, n in patterns], {s: int(wanted.get(s, 0.0)) for s in sizes})
    plan = []
    for (key, members, size), flow in zip(patterns, flows):
        words = sum(flow.values())
        whole, rest = divmod(words, size) if size else (0, 0)
        first = members[0] if members else None
        plan.append((key, wanted.get(first, 0.0), sizes.get(first, 0), whole, rest))
    few = spark.createDataFrame(plan, _PLAN)
    # Cells: at most 4096 rows a pattern.
    cells = keyed.groupBy("plan_key", "cell").agg(F.sum("size").alias("words")).join(few.select("plan_key", "rest"), "plan_key")
    upto = F.sum("words").over(Window.partitionBy("plan_key").orderBy("cell"))
    last = (
        cells.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .groupBy("plan_key")
        .agg(F.min("cell").alias("last_cell"), F.min(F.col("upto") - F.col("words")).alias("before"))
        .collect()
    )
    cut = {r["plan_key"]: (r["last_cell"], r["before"]) for r in last}
    kind = T.StructType([*_PLAN.fields, T.StructField("last_cell", T.LongType()), T.StructField("before", T.LongType())])
    full = spark.createDataFrame([(*p, *cut.get(p[0], (-1, 0))) for p in plan], kind)
    told = keyed.join(full, "plan_key")
    inner = told.where(F.col("cell") == F.col("last_cell"))
    here = Window.partitionBy("plan_key").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("rest") - F.col("before") - (F.sum("size").over(here) - F.col("size"))
    inner = inner.withColumn("more", F.least(F.col("size"), F.greatest(part, F.lit(0))))
    outer = told.where(F.col("cell") != F.col("last_cell")).withColumn("more", F.when(F.col("cell") < F.col("last_cell"), F.col("size")).otherwise(F.lit(0)))
    both = inner.unionByName(outer).withColumn("taken", (F.col("whole") * F.col("size") + F.col("more")).cast("bigint"))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], "target", "source_size", "taken")


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, members, size and hash of every document, for ``mixed``; one source each."""
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.array(F.col(source).cast("string")).alias("members"),
        word_count().alias("size"),
        seeded_hash().alias("hash"),
    )


def source_mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (see ``mixed``).

    A missing source is a source of its own, a missing or empty text has no words and gives none,
    rows that repeat count each. With no words at all every target is 0. No rows in, no rows out.
    """
    out = mixed(stored(sized(docs)))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def repeated_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as its taken words go into its size, rounded."""
    rows = whole_rows(docs, doc_id=F.col("doc_id").cast("bigint"), members=F.array(F.col("source").cast("string")), size=word_count(), hash=seeded_hash())
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = mixed(rows).where(F.col("taken") > 0).withColumn("copies", copies).where(F.col("copies") > 0)
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
