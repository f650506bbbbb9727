"""Mixing sources to target weights (operator 4) by Pfair scheduling.

Rows of a source are cut into blocks. Block j of a source with weight w of all weights W is released at slot
floor(j * W / w) and due by slot ceil((j + 1) * W / w); every slot takes the released block of earliest
deadline, so that at any slot a source is less than one block off its share. With whole-number weights the
schedule repeats after W slots; only one period is simulated, and a block's slot follows from it by
arithmetic. When a source runs out, a new phase starts with the weights of the rest. All rows are kept.

Any number of sources: up to SOURCES of them are scheduled at once; more are dealt to bundles, each bundle is scheduled
by itself in a task, and the bundles are scheduled as sources are, with the sums of their weights, over as many
levels as it takes. A block's place in its bundle is the number of the bundle's block it stands for. (A source in
bundles is less than one block of each level off its share.) Weights are whole numbers; if they sum to more than
PERIOD, the greatest period that is simulated, they are rounded to shares of it, one at least.

Ranks within a source come from counts over hash buckets and groups of these, so that no source is ranked in one
task, however large.

Defined results: null sources form one source; sources without a given weight get ``other``; a source of weight 0 has
no share and comes after all sources that have one (several: with equal weights); rows of equal id are ordered by
their text's hash, full repeats take neighbouring places; very long texts are only hashed; empty tables give no rows;
columns of docs whose names clash with the result's go into the struct ``row`` only.
"""

from __future__ import annotations

import heapq
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.simhash import join_by_key
from repolens.session import broadcast_if_small, materialize

BLOCK = 32
#: Sources that are scheduled at once at most, and about how many a bundle has where there are more.
SOURCES = 1000
BUNDLE = 500
#: Sum of whole-number weights at most.
PERIOD = 20_000
#: Rows in a hash bucket of a source, about, and buckets in a group.
BUCKET_ROWS = 1000
GROUP = 4096
#: Rows in a partition of the sorted mix, at least.
PART_ROWS = 2000
#: Ranges of slots in which incomplete blocks are counted.
RANGES = 1 << 16


def period(weights: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among released blocks (ties: lower index)."""
    total = sum(weights)
    waiting = [(0, -(-total // w), i, 0) for i, w in enumerate(weights) if w]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j))
        _, i, j = heapq.heappop(ready)
        out.append(i)
        j += 1
        if j < weights[i]:
            heapq.heappush(waiting, (j * total // weights[i], -(-(j + 1) * total // weights[i]), i, j))
    return out


def phases(weights: list[int], blocks: list[int]) -> list[tuple[int, list[int], dict[int, int]]]:
    """(first slot, one period's sources, blocks each source had placed before) until all blocks are placed."""
    out, start, done = [], 0, dict.fromkeys(range(len(blocks)), 0)
    while alive := [i for i in done if done[i] < blocks[i]]:
        now = [weights[i] for i in alive]
        if any(now):
            alive, now = [i for i in alive if weights[i]], [w for w in now if w]
        else:  # only sources without a share are left
            now = [1] * len(alive)
        turns = [alive[k] for k in period(now)]
        at: dict[int, list[int]] = {i: [] for i in alive}
        for t, i in enumerate(turns):
            at[i].append(t)
        ends = {i: (blocks[i] - done[i] - 1) // len(at[i]) * len(turns) + at[i][(blocks[i] - done[i] - 1) % len(at[i])] + 1 for i in alive}
        length = min(ends.values())
        out.append((start, turns, dict(done)))
        for i in alive:
            done[i] += length // len(turns) * len(at[i]) + sum(t < length % len(turns) for t in at[i])
        start += length
    return out


def tempered(counts: dict[str, int], power: float = 0.5, scale: int = 1000) -> dict[str, int]:
    """Whole-number target weights in proportion to counts ** power, one at least."""
    total = sum(n**power for n in counts.values()) or 1.0
    return {k: max(1, round(scale * n**power / total)) for k, n in counts.items()}


def whole(weights: list[float]) -> list[int]:
    """Weights as whole numbers without a common divisor, that sum to PERIOD at most (or so many as there are weights); 0 stays 0."""
    total = sum(weights)
    if any(w != int(w) for w in weights) or total > PERIOD:
        weights = [max(1, round(w * PERIOD / total)) if w else 0 for w in weights]
    least = gcd(*map(int, weights)) or 1
    return [int(w) // least for w in weights]


Phase = tuple[int, int, int, int, list[int]]


def schedule(names: list[str], weights: list[float], blocks: list[int]) -> list[tuple[str, list[Phase]]]:
    """For each name its phases: first slot, length of a period, first block, block after the last, slots of its blocks in a period."""
    plan = phases(whole(weights), blocks)
    by_name: dict[str, list[list]] = {k: [] for k in names}
    for start, order, done in plan:
        at: dict[int, list[int]] = {}
        for t, i in enumerate(order):
            at.setdefault(i, []).append(t)
        for i, mine in at.items():
            found = by_name[names[i]]
            if found:
                found[-1][3] = done[i]
            found.append([start, len(order), done[i], 1 << 60, mine])
    return [(k, [tuple(x) for x in v if x[3] > x[2]]) for k, v in by_name.items()]


PHASES = "phases array<struct<start:long,length:long,first:long,until:long,at:array<int>>>"


def _levels(units: DataFrame) -> list[DataFrame]:
    """Schedules for units (unit, weight, blocks, n): one table (unit, bundle, n, phases) a level, innermost first; the last has no bundles."""
    spark = units.sparkSession
    out = []
    while True:
        some = units.limit(SOURCES + 1).collect()
        if len(some) <= SOURCES:
            some.sort(key=lambda r: r["unit"])
            found = schedule([r["unit"] for r in some], [r["weight"] for r in some], [r["blocks"] for r in some])
            rows = [(k, r["n"], [*v]) for (k, v), r in zip(found, some)]
            out.append(spark.createDataFrame(rows, f"unit string, n long, {PHASES}"))
            return out
        many = units.count() // BUNDLE + 1
        dealt = units.withColumn("bundle", F.pmod(F.xxhash64("unit", F.lit(len(out))), F.lit(many)).cast("string"))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("unit")
            found = schedule(rows["unit"].tolist(), rows["weight"].tolist(), rows["blocks"].tolist())
            return pd.DataFrame({"unit": rows["unit"], "bundle": rows["bundle"], "n": rows["n"], "phases": [[{"start": a, "length": b, "first": c, "until": d, "at": e} for a, b, c, d, e in v] for _, v in found]})

        out.append(materialize(dealt.groupBy("bundle").applyInPandas(run, f"unit string, bundle string, n long, {PHASES}"), "bundles"))
        units = materialize(dealt.groupBy("bundle").agg(F.sum("weight").alias("weight"), F.sum("blocks").alias("blocks"), F.sum("n").alias("n")).withColumnRenamed("bundle", "unit"), "units")


def _slots(rows: DataFrame, levels: list[DataFrame], total: int, few: bool) -> DataFrame:
    """rows (unit, slot: a block's number in its unit, ...) with the slot of each block in the whole mix."""
    place = F.expr("p.start + (slot - p.first) div size(p.at) * p.length + p.at[cast((slot - p.first) % size(p.at) as int)]").cast("long")
    for level in levels:
        met = rows.join(F.broadcast(level.drop("n")), "unit") if few else join_by_key(rows, level, "unit", total)
        met = met.withColumn("p", F.expr("filter(phases, x -> x.first <= slot and slot < x.until)[0]")).withColumn("slot", place).drop("p", "phases", "unit")
        rows = met.withColumnRenamed("bundle", "unit") if "bundle" in level.columns else met
    return rows


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, other: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """A row per row of docs: doc_id, source ('' for null), block_no, slot, position (gapless from 0), and ``columns`` as a struct ``row``.

    weights: whole numbers by source, 0 for no share; by default tempered() of all sources' counts.
    """
    if weights is not None and any(w < 0 or w != int(w) for w in (*weights.values(), other)):
        raise ValueError("weights are whole numbers from 0")
    spark = docs.sparkSession
    body = F.xxhash64(text_col)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).alias("doc_id"), source.alias("unit"), F.shiftrightunsigned(F.xxhash64(F.col(id_col), body, F.lit(4)), 2).alias("h"), body.alias("h2")]
    base = docs.select(*keys, *([F.struct(*columns).alias("row")] if columns else []))
    counts = materialize(docs.select(source.alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "counts")
    some = counts.limit(SOURCES + 1).collect()
    few = len(some) <= SOURCES
    total = sum(r["n"] for r in some) if few else counts.agg(F.sum("n")).first()[0]
    if weights is not None:
        given = spark.createDataFrame([(k or "", float(w)) for k, w in weights.items()] or [("", float(other))], "unit string, weight double")
        units = counts.join(broadcast_if_small(given), "unit", "left").withColumn("weight", F.coalesce("weight", F.lit(float(other))))
    elif few:
        units = spark.createDataFrame([(r["unit"], r["n"], float(w)) for r, w in zip(some, tempered({r["unit"]: r["n"] for r in some}).values())], "unit string, n long, weight double")
    else:
        units = counts.withColumn("weight", F.sqrt("n"))
    units = units.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    levels = _levels(units)

    # ranks: buckets of a hash within a source, groups of buckets, then places within a bucket
    width = F.expr(f"4611686018427387904 div greatest(1, n div {BUCKET_ROWS}) + 1")
    own = counts.select("unit", width.alias("width"), "n")
    dealt = (base.join(F.broadcast(own.drop("n")), "unit") if few else join_by_key(base, own, "unit", total)).withColumn("bucket", F.expr("h div width")).drop("width")
    totals = materialize(dealt.groupBy("unit", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.expr(f"bucket div {GROUP}")), "buckets")
    up_to = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("unit", "group").agg(F.sum("n").alias("n")).withColumn("earlier", up_to("unit", "group")).drop("n")
    before = totals.withColumn("before", up_to("unit", "group", "bucket")).join(groups, ["unit", "group"]).select("unit", "bucket", (F.col("before") + F.col("earlier")).alias("before"))
    place = F.row_number().over(Window.partitionBy("unit", "bucket").orderBy("h", "h2", "doc_id")) - 1
    ranked = dealt.withColumn("place", place).join(before, ["unit", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place", "h", "h2")
    ranked = ranked.withColumn("block_no", F.floor(F.col("rank") / block).cast("long")).withColumn("slot", F.col("block_no")).withColumn("source", F.col("unit"))
    slotted = _slots(ranked, levels, total, few)

    # blocks that are not full are the last ones of their sources; ranges of slots hold what is missing before and in them
    last = units.filter(F.col("n") % block > 0).select("unit", (F.col("blocks") - 1).alias("slot"), (block - F.col("n") % block).alias("missing"))
    span = max(1, (total // block + (len(some) if few else counts.count())) // RANGES + 1)
    short = _slots(last, levels, total, few).groupBy(F.expr(f"slot div {span}").alias("range")).agg(F.sum("missing").alias("all"), F.collect_list(F.struct("slot", "missing")).alias("gaps"))
    ranges = spark.range(RANGES + 1).select(F.col("id").alias("range")).join(short, "range", "left")
    ranges = materialize(ranges.withColumn("lost", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "lost", "gaps"), "ranges")
    here = F.aggregate(F.coalesce("gaps", F.array().cast("array<struct<slot:long,missing:long>>")), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["slot"] < F.col("slot"), x["missing"]).otherwise(0))
    met = slotted.withColumn("range", F.expr(f"slot div {span}")).join(F.broadcast(ranges) if few else ranges, "range")
    out = met.withColumn("position", F.col("slot") * block + F.col("rank") % block - F.col("lost") - here)
    return out.select("doc_id", "source", "block_no", "slot", "position", *(["row"] if columns else []))


def in_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of docs with their columns, sorted by their place in the mix."""
    spark = docs.sparkSession
    rows = docs.count()
    parts = max(1, min(rows // PART_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    mixed = mix(docs, weights, block, id_col=id_col, source_col=source_col, text_col=text_col, columns=docs.columns)
    # places are gapless, so the partitions of a sorted table are known without sampling
    dealt = mixed.repartitionById(parts, F.expr(f"cast(position div {rows // parts + 1} as int)"))
    return dealt.sortWithinPartitions("position").select("row.*")
