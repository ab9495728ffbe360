"""Typed links: summaries, integrity, cycles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept


def orphans(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links whose target isn't there."""
    return links.join(targets, "target_id", "left_anti")


def misplaced(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with an end that isn't there, is of another project than the other end, or, for task relations, is no task.

    ``documents`` holds (id, project, kind); ``reason`` says which. Each end is one join on its id.
    """
    ends = documents.select("id", "project", "kind")
    source = ends.select(F.col("id").alias("source_id"), F.col("project").alias("_sp"), F.col("kind").alias("_sk"))
    target = ends.select(F.col("id").alias("target_id"), F.col("project").alias("_tp"), F.col("kind").alias("_tk"))
    joined = links.join(source, "source_id", "left").join(target, "target_id", "left")
    tasks = F.col("relation").isin("child_of", "blocked_by")
    reason = (
        F.when(F.col("_sp").isNull(), "no_source").when(F.col("_tp").isNull(), "no_target")
        .when(F.col("_sp") != F.col("_tp"), "cross_project").when(tasks & ((F.col("_sk") != "task") | (F.col("_tk") != "task")), "not_a_task")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("_sp", "_sk", "_tp", "_tk")


def summaries(edges: DataFrame) -> DataFrame:
    """(id, links): every node's links out, then in, as structs (direction, relation, other), each once, ordered.

    Links are made distinct before they are gathered. A node's summary is as long as it has links; views of one node with
    very many are better read from the link table.
    """
    out = edges.select(F.col("source_id").alias("id"), F.struct(F.lit("out").alias("direction"), F.col("relation"), F.col("target_id").alias("other")).alias("link"))
    into = edges.select(F.col("target_id").alias("id"), F.struct(F.lit("in").alias("direction"), F.col("relation"), F.col("source_id").alias("other")).alias("link"))
    whole = out.unionByName(into).where(F.col("link.other").isNotNull() & F.col("link.relation").isNotNull()).distinct()
    order = lambda a, b: F.when(a["direction"] > b["direction"], -1).when(a["direction"] < b["direction"], 1).when(F.struct(a["relation"], a["other"]) < F.struct(b["relation"], b["other"]), -1).otherwise(1)
    return whole.groupBy("id").agg(F.array_sort(F.collect_list("link"), order).alias("links"))


def summary_pages(edges: DataFrame, size: int = 1000) -> DataFrame:
    """(id, page, links, total): the links of ``summaries``, in its order, in pages of ``size`` from 0, and how many there are.

    For nodes of any number of links: these are range-partitioned by node and order, so a hub spans as many partitions as it
    fills; what is counted for each node and partition places its rows, and no list is longer than a page.
    """
    out = edges.select(F.col("source_id").alias("id"), F.lit(0).alias("side"), F.col("relation"), F.col("target_id").alias("other"))
    into = edges.select(F.col("target_id").alias("id"), F.lit(1).alias("side"), F.col("relation"), F.col("source_id").alias("other"))
    order = ["side", "relation", "other"]
    whole = out.unionByName(into).where(F.col("id").isNotNull() & F.col("other").isNotNull() & F.col("relation").isNotNull())
    # Equal links are in one range, so they are made distinct there.
    placed = whole.repartitionByRange("id", *order).dropDuplicates(["id", *order]).sortWithinPartitions("id", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "link-order")
    runs = placed.groupBy("id", "_part").agg(F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    same = Window.partitionBy("id")
    before = F.coalesce(F.sum("_rows").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("id", "_part", (before - F.col("_first")).alias("_base"), F.sum("_rows").over(same).alias("total"))
    rows = placed.join(runs, ["id", "_part"]).withColumn("_place", F.col("_base") + F.col("_nth"))
    link = F.struct("_place", "side", "relation", "other")
    pages = rows.groupBy("id", F.floor(F.col("_place") / size).cast("bigint").alias("page")).agg(F.sort_array(F.collect_list(link)).alias("links"), F.first("total").alias("total"))
    return pages.select("id", "page", F.transform("links", lambda x: F.struct(F.when(x["side"] == 0, "out").otherwise("in").alias("direction"), x["relation"].alias("relation"), x["other"].alias("other"))).alias("links"), "total")


def _doubled(jump: DataFrame) -> DataFrame:
    """Twice as many steps: from, to."""
    return jump.alias("a").join(jump.alias("b"), F.col("a.t") == F.col("b.s")).select(F.col("a.s").alias("s"), F.col("b.t").alias("t"))


def cycles(edges: DataFrame) -> DataFrame:
    """(id, depth): nodes that reach themselves, and in how many steps, where each node has at most one link out.

    Jumps of doubled length are kept for the nodes that earlier jumps end at; those become fewer until only nodes on cycles
    are left. Rounds grow with the logarithm of the longest way to a cycle, and of the longest cycle.
    """
    step = kept(edges.select("s", "t").distinct(), "steps")
    jump = step
    while True:
        ends = kept(jump.select(F.col("t").alias("s")).distinct(), "ends")
        if ends.count() == jump.count() and ends.join(jump, "s", "left_anti").isEmpty():
            break  # just the nodes left are reached, so all are on cycles
        jump = kept(_doubled(jump).join(ends, "s", "left_semi"), "jumps")
    ring = kept(step.join(ends, "s", "left_semi"), "rings")
    # Every node of a cycle takes the least node within doubled reach, until none changes: then that is the whole cycle.
    label, jump, changed = ring.select("s", F.least("s", "t").alias("low")), ring, True
    while changed:
        far = label.select(F.col("s").alias("t"), F.col("low").alias("other"))
        label = kept(jump.join(far, "t").join(label, "s").select("s", F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved")), "labels")
        changed = not label.where("moved").isEmpty()
        label, jump = label.drop("moved"), kept(_doubled(jump), "jumps")
    size = label.groupBy("low").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return label.join(size, "low").select(F.col("s").alias("id"), "depth")


def would_close(edges: DataFrame, source, target) -> bool:
    """Whether a new link from source to target closes a cycle: whether target reaches source, by any number of steps.

    Each node has at most one link out. What target reaches doubles in steps every round, so rounds grow with the logarithm
    of the chain.
    """
    if target == source:
        return True
    jump = edges.select("s", "t").distinct()
    reached = kept(edges.where(F.col("s") == target).select(F.col("t").alias("at")).distinct(), "reached")
    size = 0
    while (grown := reached.count()) > size:
        if not reached.where(F.col("at") == source).isEmpty():
            return True
        size = grown
        further = reached.join(jump, F.col("at") == F.col("s")).select(F.col("t").alias("at"))
        reached = kept(reached.union(further).distinct(), "reached")
        jump = kept(_doubled(jump), "jumps")
    return False


def _dealt(rows: DataFrame) -> DataFrame:
    """For joins of many rounds: sides are shuffled to each other. Broadcast ones would pass through the driver each round."""
    return rows.hint("shuffle_merge")


#: Steps that marks are carried along links between two writes.
HOPS = 4


def _spread(edges: DataFrame, start: DataFrame, least: bool) -> DataFrame:
    """(id, mark): the marks of ``start`` (id, mark) carried along edges (s, t) until none changes.

    With ``least`` every node has a mark and takes the least that reaches it; else marks go only to nodes of the same one:
    ``edges`` hold the mark that both ends have. Only nodes whose mark has changed send it on, ``HOPS`` steps at once.
    """
    marks, front = start, start
    while True:
        offers, at = None, front
        for _ in range(HOPS):
            sent = at.join(_dealt(edges if least else edges.withColumnRenamed("mark", "_both")), F.col("id") == F.col("s"))
            sent = sent if least else sent.where("mark = _both")
            at = sent.groupBy(F.col("t").alias("id")).agg(F.min("mark").alias("mark"))
            offers = at if offers is None else offers.unionByName(at)
        offers = offers.groupBy("id").agg(F.min("mark").alias("_offer"))
        both = marks.join(_dealt(offers), "id", "left" if least else "full")
        better = F.coalesce(F.col("_offer") < F.col("mark"), F.lit(False)) if least else F.col("mark").isNull()
        both = kept(both.select("id", F.when(better, F.col("_offer")).otherwise(F.col("mark")).alias("mark"), better.alias("_fresh")), "marks")
        marks, front = both.drop("_fresh"), both.where("_fresh").drop("_fresh")
        if front.isEmpty():
            return marks


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from a node that none reaches or to a node that reaches none, again until there are no such."""
    size = -1
    while (now := edges.count()) != size:
        size = now
        into, out = edges.select(F.col("t").alias("s")).distinct(), edges.select(F.col("s").alias("t")).distinct()
        edges = kept(edges.join(_dealt(into), "s", "left_semi").join(_dealt(out), "t", "left_semi").select("s", "t"), "trimmed")
    return edges


def _reached(rest: DataFrame) -> DataFrame:
    """(id, root) of the nodes of components of more than one, each component with one root, by steps over all links.

    Nodes that no way leads into or out of are trimmed. Of the rest each takes the first node, in the order of a hash, that
    reaches it; what in turn reaches that node, among those that took it, is its component, and goes; links between nodes
    that took different ones lie in none. The order of a hash cuts a chain of components anywhere, so rounds grow with the
    logarithm of its length rather than with it. A step is a join of the nodes just changed with their links, and steps grow
    with the longest of the shortest ways inside what isn't trimmed.
    """
    found = rest.select(F.col("s").alias("id"), F.col("s").alias("root")).where("false")
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            return found
        own = F.struct(F.xxhash64("id").alias("hash"), F.col("id").alias("node"))
        marks = _spread(rest, rest.select(F.col("s").alias("id")).distinct().withColumn("mark", own), True)
        left, right = marks.select(F.col("id").alias("s"), "mark"), marks.select(F.col("id").alias("t"), F.col("mark").alias("_other"))
        inner = kept(rest.join(_dealt(left), "s").join(_dealt(right), "t").where("mark = _other").select("s", "t", "mark"), "inner")
        back = inner.select(F.col("t").alias("s"), F.col("s").alias("t"), "mark")
        ended = _spread(back, marks.where("id = mark.node"), False)
        found = found.unionByName(ended.select("id", F.col("mark.node").alias("root")))
        gone = ended.select(F.col("id").alias("s"))
        rest = inner.select("s", "t").join(_dealt(gone), "s", "left_anti").join(_dealt(gone.withColumnRenamed("s", "t")), "t", "left_anti").select("s", "t")


#: Nodes of a block, which one task condenses, and the most rows that are given to one.
BLOCK_NODES, BLOCK_ROWS = 50_000, 500_000


def _numbered(first: list, to: list) -> list:
    """Each node's component by one walk in depth (Tarjan's): those that others lead to have lower numbers.

    Node v's links are ``to[first[v]:first[v + 1]]``.
    """
    n = len(first) - 1
    part, low, seen, upcoming, open_, count, parts = [-1] * n, [0] * n, [0] * n, first[:n], [], 0, 0
    for start in range(n):
        walk = [] if seen[start] else [start]
        while walk:
            v = walk[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                open_.append(v)
            if (i := upcoming[v]) < first[v + 1]:
                upcoming[v], w = i + 1, to[i]
                if not seen[w]:
                    walk.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
            if low[v] == seen[v]:
                while part[v] < 0:
                    part[open_.pop()] = parts
                parts += 1
    return part


def _block(rows: pa.Table) -> pa.Table:
    """(id, root, open) of a block's nodes: nodes that reach each other inside it have one root; ``open`` are those that a
    link from outside leads to and that lead outside, so that their component may go on there.

    Rows are links (s, t); where t is null, s has a link to another block, where s is null, t has one from another.
    """
    ids = pc.unique(pa.chunked_array([*rows["s"].chunks, *rows["t"].chunks])).drop_null()
    s, t = (pc.fill_null(pc.index_in(rows[c], value_set=ids), -1).to_numpy() for c in ("s", "t"))
    inside = (s >= 0) & (t >= 0)
    a, b = s[inside], t[inside]
    order = np.argsort(a, kind="stable")
    part = np.array(_numbered(np.searchsorted(a[order], np.arange(len(ids) + 1)).tolist(), b[order].tolist()), dtype=np.int64)
    lead = np.zeros(len(ids), dtype=np.int64)
    lead[part] = np.arange(len(ids))
    into, out = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
    into[part[t[s < 0]]], out[part[s[t < 0]]] = True, True
    a, b = part[a], part[b]
    order = np.argsort(a, kind="stable")
    links, into, out = list(zip(a[order].tolist(), b[order].tolist())), into.tolist(), out.tolist()
    for x, y in links:
        out[x] = out[x] or out[y]
    for x, y in reversed(links):
        into[y] = into[y] or into[x]
    opened = (np.array(into, dtype=bool) & np.array(out, dtype=bool))[part]
    return pa.table([ids, ids.take(pa.array(lead[part])), pa.array(opened)], names=["id", "root", "open"])


def _condensed(links: DataFrame, nodes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(id, root, open) of all nodes after each block has been condensed, and the links (s, t) between open roots.

    Blocks are ranges of ids with some ``BLOCK_NODES`` of the ``count`` nodes each. Components that no way leaves and comes
    back to lie inside a block, so they are whole and go, with their links. A block of more than ``BLOCK_ROWS`` rows stays as
    it is.
    """
    blocks = -(-count // BLOCK_NODES)
    if blocks > 1:
        dealt = kept(nodes.repartitionByRange(blocks, "id").withColumn("_block", F.spark_partition_id()), "blocks")
        left, right = dealt.select(F.col("id").alias("s"), F.col("_block").alias("_a")), dealt.select(F.col("id").alias("t"), F.col("_block").alias("_b"))
        placed = links.join(_dealt(left), "s").join(_dealt(right), "t")
        none = F.lit(None).cast(links.schema["s"].dataType)
        row = lambda block, s, t: F.struct(F.col(block).alias("block"), s.alias("s"), t.alias("t"))
        both, apart = F.array(row("_a", F.col("s"), F.col("t"))), F.array(row("_a", F.col("s"), none), row("_b", none, F.col("t")))
        inner = placed.select(F.inline(F.when(F.col("_a") == F.col("_b"), both).otherwise(apart))).distinct()
    else:
        inner = links.select(F.lit(0).alias("block"), "s", "t")
    inner = kept(inner, "inner")
    id_type = links.schema["s"].dataType.simpleString()
    large = inner.groupBy("block").count().where(F.col("count") > BLOCK_ROWS).select("block")
    fit, whole = inner, None
    if not large.isEmpty():
        fit, whole = inner.join(_dealt(large), "block", "left_anti"), inner.join(_dealt(large), "block", "left_semi")
    marks = fit.groupBy("block").applyInArrow(_block, f"id {id_type}, root {id_type}, open boolean")
    if whole is not None:
        same = whole.select(F.explode(F.array("s", "t")).alias("id")).where("id IS NOT NULL").distinct()
        marks = marks.unionByName(same.select("id", F.col("id").alias("root"), F.lit(True).alias("open")))
    marks = kept(marks, "marks")
    still = marks.where("open")
    left, right = still.select(F.col("id").alias("s"), F.col("root").alias("_a")), still.select(F.col("id").alias("t"), F.col("root").alias("_b"))
    between = links.join(_dealt(left), "s").join(_dealt(right), "t").where("_a <> _b").select(F.col("_a").alias("s"), F.col("_b").alias("t")).distinct()
    return marks, kept(between, "trimmed")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component, size): nodes of links (s, t) that reach each other have one component, its least node; any number of
    links out. Nodes alone are components of their own; links with a null end count for nothing.

    Rounds condense blocks of nodes with near ids: what is strongly connected inside a block becomes one node, what no way
    leaves and comes back to is done. What is left of a round is dealt into blocks anew, so links between near ids take few
    rounds however long their ways are. Where a round leaves more than three quarters of the links, the rest is found by
    steps over all links (``_reached``).
    """
    whole = kept(edges.where("s IS NOT NULL AND t IS NOT NULL").select("s", "t").distinct(), "edges")
    nodes = kept(whole.select(F.col("s").alias("id")).union(whole.select("t")).distinct(), "nodes")
    rest, left, levels = whole.where("s <> t"), nodes, []
    size = rest.count()
    while size:
        before, count = size, left.count()
        marks, rest = _condensed(rest, left, count)
        levels.append(marks.select("id", "root"))
        left, size = marks.where("open").select(F.col("root").alias("id")).distinct(), rest.count()
        if 4 * size > 3 * before:
            levels.append(_reached(rest))
            break
    named = levels.pop() if levels else nodes.select("id", F.col("id").alias("root"))
    for level in reversed(levels):
        further = named.select(F.col("id").alias("root"), F.col("root").alias("_further"))
        named = level.join(_dealt(further), "root", "left").select("id", F.coalesce("_further", "root").alias("root"))
    named = nodes.join(_dealt(named), "id", "left").select("id", F.coalesce("root", "id").alias("_root"))
    sizes = named.groupBy("_root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return named.join(_dealt(sizes), "_root").select("id", "component", "size")


def closing(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed`` links (s, t), with ``closes``: whether a link lies on a cycle if all were added to ``edges`` at once.

    All are answered together: a link lies on a cycle just if its ends are in one strong component, or are one node. A null
    end closes nothing.
    """
    asked = kept(proposed, "proposed")
    parts = strong_components(edges.select("s", "t").unionByName(asked.select("s", "t"))).where("size > 1")
    source, target = parts.select(F.col("id").alias("s"), F.col("component").alias("_a")), parts.select(F.col("id").alias("t"), F.col("component").alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)) | F.coalesce(F.col("s") == F.col("t"), F.lit(False))
    return asked.join(_dealt(source), "s", "left").join(_dealt(target), "t", "left").select(*asked.columns, same.alias("closes"))
