"""Expansion along relationships, paths of variable length, shortest paths, triads.

A path is two arrays, nodes and rels. A relationship occurs at most once in a
path; nodes may repeat. Relationship tables have id, type, src, dst.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.operators.scans import both_ways
from chronoweave.storage import settle, settle_by

#: Nodes in one packed list, walks that one task takes of one start, and cells that starts are dealt into.
LIST, SHARE, CELLS = 512, 2_000_000, 4096


def oriented(rels: DataFrame, direction: str = "out") -> DataFrame:
    """Relationships as (rel, from_id, to_id, ...) for walking out, in or both ways."""
    if direction == "both":
        found = both_ways(rels).drop("forward")
    elif direction == "in":
        found = rels.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    else:
        found = rels
    return found.withColumnsRenamed({"id": "rel", "src": "from_id", "dst": "to_id"})


def expand(rows: DataFrame, rels: DataFrame, start: str, rel: str, end: str, direction: str = "out", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with each relationship from its node `start`: its id as `rel`, the other node as `end`, and columns `keep`."""
    hops = oriented(rels, direction).select(F.col("from_id").alias(start), F.col("rel").alias(rel), F.col("to_id").alias(end), *keep)
    return rows.join(hops, start)


def expand_into(rows: DataFrame, rels: DataFrame, start: str, end: str, rel: str, direction: str = "out") -> DataFrame:
    """The relationships between two bound nodes."""
    hops = oriented(rels, direction).select(F.col("from_id").alias(start), F.col("to_id").alias(end), F.col("rel").alias(rel))
    return rows.join(hops, [start, end])


def optional_expand(rows: DataFrame, rels: DataFrame, start: str, rel: str, end: str, direction: str = "out", keep: tuple[str, ...] = ()) -> DataFrame:
    """As expand; a row without any gets nulls. Filter rels beforehand: the predicate is part of the outer join."""
    hops = oriented(rels, direction).select(F.col("from_id").alias(start), F.col("rel").alias(rel), F.col("to_id").alias(end), *keep)
    return rows.join(hops, start, "left")


def project_endpoints(rows: DataFrame, rels: DataFrame, rel: str, start: str, end: str, directed: bool = True, types: tuple[str, ...] = ()) -> DataFrame:
    """The two nodes of a bound relationship; no row if it is null or of another type; both ways if undirected."""
    found = rels.where(F.col("type").isin(list(types))) if types else rels
    found = found if directed else both_ways(found)
    return rows.join(found.select(F.col("id").alias(rel), F.col("src").alias(start), F.col("dst").alias(end)), rel)


def var_expand(
    rows: DataFrame,
    rels: DataFrame,
    start: str,
    end: str,
    low: int,
    high: int,
    direction: str = "out",
    nodes_ok: DataFrame | None = None,
    path: str = "path",
    ends: DataFrame | None = None,
) -> DataFrame:
    """Each row with each path of low to high relationships from `start`: last node as `end`, struct `path` (nodes, rels).

    No relationship repeats in a path. rels is filtered beforehand for
    predicates on relationships; nodes_ok (column id) holds the nodes that a path
    may go on to. low 0 gives the node itself. The joins are unrolled, one for each
    length, on the walked-to node; what a later length reads is written to the
    shared folder, so no length is walked twice. Until they are given, paths are
    plain columns, and relationships are packed lists in buckets of their nodes, so
    a join shuffles the paths alone. With ends (column id) only paths to these nodes
    are given, and no relationship is walked from which none of them is near enough.
    """
    hops = oriented(rels, direction).select("from_id", "rel", "to_id")
    if nodes_ok is not None:
        hops = hops.join(nodes_ok.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "rel", "to_id")
    if ends is not None:
        hops = towards(hops, ends, high)
    elif high > 1:
        hops = packed(hops, "rel")
    level = rows.withColumn(end, F.col(start))
    out = _paths(level, rows.columns, start, end, 0, path) if low == 0 else None
    for depth in range(1, high + 1):
        near = hops if ends is None else hops.where(F.col("left") <= high - depth)
        step = level.join(near, level[end] == near["from_id"])
        if "to_ids" in hops.columns:
            step = step.select(*level.columns, F.col("rel").alias("_rels"), F.posexplode("to_ids").alias("_at", "to_id")).withColumn("rel", F.col("_rels")[F.col("_at")])
        for walked in range(1, depth):
            step = step.where(F.col("rel") != F.col(f"_rel{walked}"))
        inner = (F.col(end).cast("bigint").alias(f"_node{depth - 1}"),) if depth > 1 else ()
        level = step.select(*(c for c in level.columns if c != end), *inner, F.col("rel").cast("bigint").alias(f"_rel{depth}"), F.col("to_id").alias(end))
        if depth < high:
            level = settle(level, "paths")
        if depth >= low:
            now = _paths(level, rows.columns, start, end, depth, path)
            out = now if out is None else out.unionByName(now)
    out = out if out is not None else _paths(level, rows.columns, start, end, high, path).where(F.lit(False))
    return out if ends is None else out.join(ends.select(F.col("id").alias(end)), end, "left_semi").select(*out.columns)


def _paths(level: DataFrame, columns: list[str], start: str, end: str, depth: int, path: str) -> DataFrame:
    """Rows of var_expand with `depth` relationships, their path put together."""
    nodes = [F.col(c).cast("bigint") for c in (start, *(f"_node{i}" for i in range(1, depth)), *([end] if depth else ()))]
    walked = F.array(*(F.col(f"_rel{i}") for i in range(1, depth + 1))).cast("array<bigint>")
    return level.select(*columns, *(() if end in columns else (end,)), F.struct(F.array(*nodes).alias("nodes"), walked.alias("rels")).alias(path))


def towards(steps: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """The steps (from_id, rel, to_id) of which a walk of `most` steps to a node of ends (column id) can consist.

    left: how many more steps there are at least from to_id to the nearest of
    ends. It is found backwards from all ends together, so each node counts once.
    """
    steps = settle(steps, "steps")
    level = settle(ends.select(F.col("id").alias("to_id")).distinct().withColumn("left", F.lit(0)), "ends")
    seen = level
    for left in range(1, most):
        found = steps.join(level.select("to_id"), "to_id", "left_semi").select(F.col("from_id").alias("to_id")).distinct()
        level = settle(found.join(seen, "to_id", "left_anti").withColumn("left", F.lit(left)), "ends")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return settle(steps.join(seen, "to_id"), "towards")


def packed(steps: DataFrame, *values: str) -> DataFrame:
    """Steps (from_id, to_id, values) as from_id, n, to_ids and an array for each of values: lists of at most LIST steps, written in buckets of from_id."""
    place = Window.partitionBy("from_id").orderBy("to_id")
    cut = steps.withColumn("_cut", F.floor((F.row_number().over(place) - 1) / LIST))
    lists = cut.groupBy("from_id", "_cut").agg(F.collect_list(F.struct("to_id", *values)).alias("_p"))
    arrays = (F.col(f"_p.{c}").alias("to_ids" if c == "to_id" else c) for c in ("to_id", *values))
    return settle_by(lists.select("from_id", F.size("_p").alias("n"), *arrays), "lists", "from_id")


def celled(starts: DataFrame) -> DataFrame:
    """cell, start: the distinct ids of starts, dealt into about CELLS cells of neighbours in order of id. Starts near each other often meet the same nodes."""
    starts = settle(starts.select(F.col("id").alias("start")).distinct(), "starts")
    n = starts.count()
    place = starts.repartitionByRange(max(1, math.ceil(n / 200_000)), "start").sortWithinPartitions("start").select(F.monotonically_increasing_id().alias("at"), "start")
    return settle(place.select(F.floor(F.col("at") / max(1, math.ceil(n / CELLS))).alias("cell"), "start"), "cells")


def dealt(known: DataFrame, lists: DataFrame, carry: tuple[str, ...] = (), values: tuple[str, ...] = (), block: int = 2) -> list[tuple[DataFrame, list[str]]]:
    """One step on from known (cell, start, end, go, old, carry), dealt out so that what meets in a node of a start is in one task.

    Each result has cell, start, carry, node, to_ids, values, and the columns
    that its rows are dealt by. go: the step leads on from end, to to_ids. old:
    end is known to its start, and given as node; else node is null. Neighbouring
    cells form a block, a task's share of about `block` * SHARE walks (two fit in
    memory as rows, four as arrays); a node's list is sent to a block once,
    however many of its starts walk it, and meets them there. Starts of a crowded
    cell are dealt out one by one, each with its lists, and one of over SHARE
    walks by its nodes too, so a hub's walks aren't one task's. Empty if no step
    leads on.
    """
    spark = known.sparkSession
    going = known.where("go")
    sizes = lists.select(F.col("from_id").alias("end"), "n").hint("merge")  # the pairs may be many even if their files are small
    walks = going.groupBy("cell", "end").agg(F.count("*").alias("c")).join(sizes, "end").select("cell", (F.col("c") * F.col("n")).alias("walks"))
    walks = walks.groupBy("cell").agg(F.sum("walks").alias("n"))
    walks = settle(known.groupBy("cell").agg(F.count("*").alias("pairs")).join(walks, "cell", "left").select("cell", "n", (F.col("pairs") + F.coalesce("n", F.lit(0))).alias("walks")), "walks")
    steps, total, largest = walks.agg(F.sum("n"), F.sum("walks"), F.max("walks")).first()
    if not steps:
        return []
    few, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    tasks = max(math.ceil(total / (block * SHARE)), min(few, max(math.ceil(total / SHARE), min(cores, math.ceil(total / 50_000)))))
    before = F.sum("walks").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # a row for each cell
    crowded = walks.where(F.col("walks") > 2 * SHARE).select("cell")
    plan = walks.where(F.col("walks") <= 2 * SHARE).select("cell", F.floor(F.coalesce(before, F.lit(0)) * tasks / total).cast("int").alias("block"))
    plan = F.broadcast(settle(plan, "blocks"))
    out = [_by_block(known.join(plan, "cell"), lists, carry, values, tasks)]
    if largest > 2 * SHARE:
        out.append(_by_start(known.join(F.broadcast(crowded), "cell"), lists, carry, values))
    return out


def _by_block(known: DataFrame, lists: DataFrame, carry: tuple[str, ...], values: tuple[str, ...], tasks: int) -> tuple[DataFrame, list[str]]:
    """Known pairs and the lists that a block needs meet in the block's task, by node."""
    need = known.where("go").select("block", F.col("end").alias("from_id")).distinct()
    own = ("cell", "start", "go", "old", *carry)
    sent = known.select("block", F.col("end").alias("node"), *own).unionByName(need.join(lists, "from_id").select("block", F.col("from_id").alias("node"), "to_ids", *values), allowMissingColumns=True)
    each = (F.collect_list(c).alias(c) for c in own)  # none of them is null but in the rows of lists
    met = sent.repartitionById(tasks, "block").groupBy("block", "node").agg(*each, *(F.flatten(F.collect_list(c)).alias(c) for c in ("to_ids", *values)))
    met = met.select("*", F.posexplode("start").alias("_at", "_start"))
    at = lambda c: F.col(c)[F.col("_at")]
    rows = met.select(
        "block", at("cell").alias("cell"), F.col("_start").alias("start"), *(at(c).alias(c) for c in carry), F.when(at("old"), F.col("node")).alias("node"),
        *(F.when(at("go"), F.col(c)).otherwise(F.array()).alias(c) for c in ("to_ids", *values)),
    )
    return rows.where("node is not null or size(to_ids) > 0"), ["block", "start"]


def _by_start(known: DataFrame, lists: DataFrame, carry: tuple[str, ...], values: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Each start with its own copy of the lists it needs, packed on the way; a start of over SHARE walks by its nodes too."""
    going = known.where("go").join(lists, F.col("end") == F.col("from_id"))
    count = settle(going.groupBy("start").agg(F.sum("n").alias("n")), "counts")
    total = count.agg(F.sum("n")).first()[0] or 0
    held = ("to_ids", *values)
    rows = going.select("cell", "start", *carry, *held)
    rows = rows.unionByName(known.where("old").select("cell", "start", *carry, F.col("end").alias("node")), allowMissingColumns=True)
    large = count.where(F.col("n") > SHARE).select("start", F.ceil(F.col("n") / SHARE).alias("_parts"))  # at most one start for each SHARE walks
    part = lambda x: F.pmod(F.xxhash64(x), F.col("_parts")).alias("part")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), *held))
    each = F.transform(F.arrays_zip(*held), lambda x: F.struct(part(x["to_ids"]), *(F.array(x[c]).alias(c) for c in held)))
    once = F.array(F.struct(part(F.col("node")), *held))
    rows = rows.join(F.broadcast(large), "start", "left")
    rows = rows.select("cell", "start", *carry, "node", F.inline(F.when(F.col("_parts").isNull(), whole).when(F.col("node").isNotNull(), once).otherwise(each)))
    rows = rows.select("cell", "start", "part", *carry, "node", *(F.coalesce(c, F.array()).alias(c) for c in held))
    return rows.repartition(max(1, math.ceil(total / SHARE)), "start", "part"), ["start", "part"]


def _depths(starts: DataFrame, rels: DataFrame, most: int, direction: str, itself: bool) -> DataFrame:
    """start, end, hops: the least number of relationships, up to `most`, from each start; itself: the start at 0.

    Each pair is followed once, at the least depth. A frontier's lists meet what
    was seen before in their start's task; levels that a later round reads are
    written to the shared folder, the last one isn't.
    """
    lists = packed(oriented(rels, direction).select("from_id", "to_id").repartition("from_id").distinct())  # one shuffle for both
    level = celled(starts).select("cell", "start", F.col("start").alias("end"), F.lit(0).alias("hops"))
    out = level if itself else level.where(F.lit(False))
    for depth in range(1, most + 1):
        known = out.where(F.col("hops") < depth - 1).withColumns({"go": F.lit(False), "old": F.lit(True)})
        known = known.unionByName(level.withColumns({"go": F.lit(True), "old": F.lit(itself or depth > 1)}))
        new = F.array_except(F.flatten(F.collect_list("to_ids")), F.collect_list("node"))
        found = [rows.groupBy(*by).agg(F.max("cell").alias("cell"), new.alias("ends")).select("cell", "start", F.explode("ends").alias("end"), F.lit(depth).alias("hops")) for rows, by in dealt(known, lists, block=4)]
        if not found:
            break
        level = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if depth < most:
            level = settle(level, "level")
        out = out.unionByName(level)
    return out.drop("cell")


def reachable(starts: DataFrame, rels: DataFrame, high: int, low: int = 1, direction: str = "out") -> DataFrame:
    """start, end: distinct pairs joined by a walk of low to high relationships (low 0 or 1)."""
    if low > 1:
        raise ValueError("shortest depths only tell walks of at least 0 or 1")
    return _depths(starts, rels, high, direction, itself=low == 0).select("start", "end")


def shortest_lengths(starts: DataFrame, rels: DataFrame, most: int, direction: str = "out") -> DataFrame:
    """start, end, hops: the least number of relationships from each start, up to `most`; the start itself at 0."""
    return _depths(starts, rels, most, direction, itself=True)


def shortest_paths(pairs: DataFrame, rels: DataFrame, most: int, direction: str = "out", every: bool = False) -> DataFrame:
    """start, end, path of a shortest path (every: all of them) between the pairs (start, end), up to `most` relationships.

    Levels are grown from the starts with one arriving relationship kept for each
    node (every: all that arrive at the node's least depth), so a frontier holds
    nodes and no paths; then paths are read back from the ends. Of several
    shortest paths the one with the smallest last relationship, then the one
    before, and so on, is taken. A node from which no end is near enough is not
    gone to.
    """
    wanted = pairs.select("start", "end").distinct()
    steps = towards(oriented(rels, direction).select("from_id", "rel", "to_id"), wanted.select(F.col("end").alias("id")), most)
    level = wanted.select("start", F.col("start").alias("node")).distinct()
    seen, levels = level, []
    for depth in range(1, most + 1):
        near = steps.where(F.col("left") <= most - depth)
        found = level.join(near, level["node"] == near["from_id"]).join(seen.withColumnRenamed("node", "to_id"), ["start", "to_id"], "left_anti")
        arrive = found.select("start", F.col("to_id").alias("node"), "rel", F.col("from_id").alias("prior"))
        if not every:
            arrive = arrive.groupBy("start", "node").agg(F.min(F.struct("rel", "prior")).alias("a")).select("start", "node", "a.rel", "a.prior")
        arrive = settle(arrive, "arrivals")
        if arrive.isEmpty():
            break
        levels.append(arrive)
        level = arrive.select("start", "node").distinct()
        seen = seen.unionByName(level)
    none = F.array().cast("array<bigint>")
    out = wanted.where("start = end").select("start", "end", F.array(F.col("start").cast("bigint")).alias("nodes"), none.alias("rels"))
    for depth in range(len(levels), 0, -1):
        back = wanted.join(levels[depth - 1].select("start", F.col("node").alias("end")).distinct(), ["start", "end"], "left_semi")
        back = back.withColumns({"at": F.col("end"), "nodes": F.array(F.col("end").cast("bigint")), "rels": none})
        for d in range(depth, 0, -1):
            back = back.join(levels[d - 1].withColumnRenamed("node", "at"), ["start", "at"]).select(
                "start", "end", F.col("prior").alias("at"), F.array_prepend("nodes", F.col("prior")).alias("nodes"), F.array_prepend("rels", F.col("rel")).alias("rels")
            )
        out = out.unionByName(back.drop("at"))
    return out.select("start", "end", F.struct("nodes", "rels").alias("path"))


def triads(rows: DataFrame, rels: DataFrame, first: str, last: str, closed: bool, direction: str = "out") -> DataFrame:
    """Rows whose nodes first and last are (closed) or are not (open) joined by a relationship.

    Both sides are written and dealt out by both nodes, in as many tasks as their
    rows need, so a task's memory doesn't grow with them. A distinct() of first
    and last over the result needs no shuffle.
    """
    ends = settle(oriented(rels, direction).select(F.col("from_id").alias(first), F.col("to_id").alias(last)), "ends")
    rows = settle(rows, "rows")
    tasks = max(1, math.ceil((rows.count() + ends.count()) / SHARE))
    return rows.repartition(tasks, first, last).join(ends.repartition(tasks, first, last), [first, last], "left_semi" if closed else "left_anti")


def degrees(nodes: DataFrame, rels: DataFrame, direction: str = "out") -> DataFrame:
    """id, degree of each node, 0 without relationships. A hub's count is combined in the map tasks."""
    n = oriented(rels, direction).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def start_node(rows: DataFrame, rels: DataFrame, nodes: DataFrame, rel: str, prefix: str = "start_") -> DataFrame:
    return _end_node(rows, rels, nodes, rel, "src", prefix)


def end_node(rows: DataFrame, rels: DataFrame, nodes: DataFrame, rel: str, prefix: str = "end_") -> DataFrame:
    return _end_node(rows, rels, nodes, rel, "dst", prefix)


def _end_node(rows: DataFrame, rels: DataFrame, nodes: DataFrame, rel: str, side: str, prefix: str) -> DataFrame:
    ends = rels.select(F.col("id").alias(rel), F.col(side).alias(f"{prefix}id"))
    return rows.join(ends, rel).join(nodes.select(*(F.col(c).alias(f"{prefix}{c}") for c in nodes.columns)), f"{prefix}id")


def path_length(path: Column) -> Column:
    return F.size(path["rels"])
