"""Paths on skeletons: tables of pixels or edges of many graphs at once, walked by rounds over their junctions.

A graph is a value of `graph`; nodes are longs. Stretches without a junction are one step, found by pointer doubling, so the number of
rounds goes with the blocks of node numbers on a path and not with its pixels. Every round is written to the shared folder.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.scratch import saved

BLOCK = 12  # bits of node numbers of a graph whose ways a task follows at once
ROW = 1 << 31  # a pixel's node is row * ROW + column


def pixel_edges(pixels: DataFrame) -> DataFrame:
    """graph, u, v, w: each pixel of skeletons (graph, row, col) with its neighbours, also diagonal ones, both ways; w is the distance.

    Repeated pixels count once, those with a null are ignored; a pixel without neighbours has no edge. Rows and columns are from 0.
    """
    p = pixels.where("graph is not null and row is not null and col is not null").select("graph", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    asked = p.withColumn("s", F.explode(steps)).select("graph", (F.col("row") * ROW + F.col("col")).alias("u"), (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.when(F.col("s.a") * F.col("s.b") == 0, 1.0).otherwise(2.0**0.5).alias("w"))
    return both_ways(asked.join(p, ["graph", "row", "col"]).select("graph", "u", (F.col("row") * ROW + F.col("col")).alias("v"), "w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """graph, u, v, w with each edge in both directions, of repeated ones the shortest; loops, nulls and w that are not above 0 and finite are left out."""
    e = edges.where("graph is not null and u is not null and v is not null and u != v and w > 0 and w < double('infinity')").select("graph", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    return e.union(e.select("graph", "v", "u", "w")).groupBy("graph", "u", "v").agg(F.min("w").alias("w"))


def _stretches(edges: DataFrame, stops: DataFrame, most: int | None = None) -> DataFrame:
    """graph, u, v, end, length, steps: where the walk that starts along an edge (u, v) first meets a stop, and how far that is.

    Nodes that are no stops have two neighbours. Pointers double until all stand, for which every ring must have a stop, or until each
    has made `most` steps: a walk that meets no stop by then may end at any node on its way.
    """
    stop = stops.select("graph", F.col("node").alias("u"), F.lit(True).alias("stop"))
    e = saved(edges.join(stop, ["graph", "u"], "left").select("graph", "u", "v", "w", F.coalesce("stop", F.lit(False)).alias("stop")), "edges")
    into = e.where("stop").select("graph", F.col("v").alias("u"), F.col("u").alias("v"), F.col("u").alias("end"), F.col("w").alias("length"), F.lit(1).cast("long").alias("steps"))
    inner = saved(e.where("not stop").groupBy("graph", F.col("u").alias("node")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min_by("w", "v").alias("wa"), F.max_by("w", "v").alias("wb")), "inner")
    # a pointer is the walk from (u, v) up to the edge (pu, pv): with it if that meets a stop, else without it
    way = lambda u, x, w, lw: F.struct(F.col(u).alias("u"), F.col("node").alias("v"), F.col(x).alias("x"), F.col(w).alias("w"), F.col(lw).alias("lw"))
    both = inner.select("graph", F.explode(F.array(way("a", "b", "wa", "wb"), way("b", "a", "wb", "wa"))).alias("p")).select("graph", "p.*")
    met = both.join(inner.select("graph", F.col("node").alias("x"), F.lit(False).alias("done")), ["graph", "x"], "left").withColumn("done", F.coalesce("done", F.lit(True)))
    made = saved(met.select("graph", "u", "v", F.col("v").alias("pu"), F.col("x").alias("pv"), F.when(F.col("done"), F.col("w") + F.col("lw")).otherwise(F.col("w")).alias("w"), F.when(F.col("done"), 2).otherwise(1).cast("long").alias("steps"), "done"), "pointers")
    stand, on, made_steps = made.where("done"), made.where("not done"), 1
    # only what still walks is joined and written again
    while (most is None or made_steps + 1 < most) and not on.isEmpty():
        to = stand.union(on).select("graph", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("w").alias("qw"), F.col("steps").alias("qs"), F.col("done").alias("qd"))
        made = saved(on.join(to, ["graph", "pu", "pv"]).select("graph", "u", "v", F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("w") + F.col("qw")).alias("w"), (F.col("steps") + F.col("qs")).alias("steps"), F.col("qd").alias("done")), "pointers")
        stand, on, made_steps = stand.union(made.where("done")), made.where("not done"), 2 * made_steps
    end = lambda df, c: df.select("graph", "u", "v", F.col(c).alias("end"), F.col("w").alias("length"), "steps")
    return into.union(end(stand, "pv")).union(end(on, "pu"))


def _degrees(edges: DataFrame) -> DataFrame:
    """graph, node, degree, and whether the node is less than all its neighbours, as some node of every ring is."""
    return edges.groupBy("graph", F.col("u").alias("node")).agg(F.count("*").alias("degree"), (F.min("v") > F.col("u")).alias("low"))


def _nearer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one block (its hops, and what is known of its nodes) that come nearer, and (new) those of others that ways from here reach."""
    hop, at = pdf[pdf.length.notna()], pdf[pdf.length.isna()]
    here, ahead = pdf.block.iloc[0], {}
    for u, v, w in zip(hop.node.tolist(), hop.end.tolist(), hop.length.tolist()):
        ahead.setdefault(u, []).append((v, w))
    best = dict(zip(at.node.tolist(), at.distance.tolist()))
    heap, found = [(best[n], n) for n in at.node[at.new].tolist()], {}
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in ahead.get(u, ()):
            inside = v >> BLOCK == here
            if d + w < (best if inside else found).get(v, math.inf):
                found[v] = d + w
                if inside:
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    nodes = list(found)
    return pd.DataFrame({"graph": pd.Series([pdf.graph.iloc[0]] * len(nodes), dtype=pdf.graph.dtype), "node": pd.Series(nodes, dtype="int64"), "distance": pd.Series(list(found.values()), dtype="float64"), "new": pd.Series([v >> BLOCK != here for v in nodes], dtype=bool)})


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """graph, node, distance, prev: the shortest way to each node that the starts (graph, node) of its graph reach; edges as of both_ways.

    A round follows all ways within a block of node numbers, so rounds go with the blocks on a way; only blocks in which a node came nearer
    from outside are looked at in the next. prev is the neighbour the way
    comes from (ties: the lesser one), null at a start. Starts without an edge are left out.
    """
    edges = saved(edges, "edges")
    first = saved(starts.join(edges.select("graph", F.col("u").alias("node")), ["graph", "node"], "left_semi").select("graph", "node").distinct(), "starts")
    stops = saved(_degrees(edges).where("degree != 2 or low").select("graph", "node").union(first).distinct(), "stops")
    stretches = _stretches(edges, stops)
    # between two stops the shortest stretch
    hops = stretches.join(stops.withColumnRenamed("node", "u"), ["graph", "u"], "left_semi").where("u != end").groupBy("graph", "u", "end").agg(F.min("length").alias("length"))
    hops = saved(hops.select("graph", F.col("u").alias("node"), "end", "length"), "hops")
    known = saved(first.withColumns({"distance": F.lit(0.0), "new": F.lit(True)}), "distances")
    block = F.shiftright("node", BLOCK).alias("block")
    ahead = hops.select("graph", block, "node", "end", "length", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("new"))
    while not known.where("new").isEmpty():
        at = known.select("graph", block, "node", F.col("node").alias("end"), F.lit(None).cast("double").alias("length"), "distance", "new")
        active = at.where("new").select("graph", "block").distinct()
        reached = ahead.union(at).join(active, ["graph", "block"], "left_semi").groupBy("graph", "block").applyInPandas(_nearer, known.select("graph", "node", "distance", "new").schema)
        best = known.withColumn("new", F.lit(False)).union(reached).groupBy("graph", "node").agg(F.min(F.struct("distance", "new")).alias("m"))  # equal: what was there
        known = saved(best.select("graph", "node", "m.*"), "distances")
    at = known.select("graph", F.col("node").alias("end"), "distance")
    inner = stretches.join(stops.withColumnRenamed("node", "u"), ["graph", "u"], "left_anti").join(at, ["graph", "end"])
    every = saved(inner.groupBy("graph", F.col("u").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("distance")).union(known.select("graph", "node", "distance")), "distances")
    near = every.join(edges.select("graph", F.col("u").alias("node"), "v", "w"), ["graph", "node"]).join(every.select("graph", F.col("node").alias("v"), F.col("distance").alias("from")), ["graph", "v"])
    prev = near.groupBy("graph", "node").agg(F.min(F.struct((F.col("from") + F.col("w")).alias("d"), "v")).alias("m")).select("graph", "node", F.col("m.v").alias("prev"))
    mark = first.withColumn("start", F.lit(True))
    return every.join(prev, ["graph", "node"]).join(mark, ["graph", "node"], "left").select("graph", "node", "distance", F.when(F.col("start").isNull(), F.col("prev")).alias("prev"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """graph, place (from 0), node, distance along the path between two far ends of each graph; edges as of both_ways.

    From the least end, or the least node where there is none, to the farthest node and from that to the farthest again (ties: the
    least); of what the first end reaches. The steps back are doubled, so a path takes as many rounds as the logarithm of its nodes.
    """
    edges = saved(edges, "edges")
    start = _degrees(edges).groupBy("graph").agg(F.min(F.struct((F.col("degree") != 1).alias("inner"), "node")).alias("m")).select("graph", "m.node")
    farthest = lambda d: d.groupBy("graph").agg(F.min(F.struct((-F.round("distance", 9)).alias("d"), "node")).alias("m")).select("graph", "m.node")
    start = saved(farthest(distances(edges, start)), "starts")
    ways = saved(distances(edges, start), "ways")
    path = saved(farthest(ways).select("graph", "node", F.lit(0).cast("long").alias("back")), "path")
    jumps, k = ways.select("graph", "node", F.col("prev").alias("to")).where("to is not null"), 0
    while True:
        more = path.join(jumps, ["graph", "node"]).select("graph", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        if more.isEmpty():
            break
        second = jumps.select("graph", F.col("node").alias("to"), F.col("to").alias("to2"))
        path, jumps, k = saved(path.union(more), "path"), saved(jumps.join(second, ["graph", "to"]).select("graph", "node", F.col("to2").alias("to")), "jumps"), k + 1
    total = path.groupBy("graph").agg(F.max("back").alias("n"))
    return path.join(total, "graph").join(ways, ["graph", "node"]).select("graph", (F.col("n") - F.col("back")).alias("place"), "node", "distance")


def pruned(edges: DataFrame, least: int, keep: int = 8) -> DataFrame:
    """edges (as of both_ways) without side branches: from an end to a junction at most `least` nodes, the junction counted.

    Whole branches go or stay, long ones are not shortened, and paths without a junction stay. Rounds go on until no branch is short, as a
    junction may become an end; a graph that would be left with fewer than `keep` nodes stays as it was before that round.
    """
    edges, settled = saved(edges, "edges"), None
    while True:
        deg = saved(_degrees(edges), "degrees")
        walks = _stretches(edges, deg.where("degree != 2").select("graph", "node"), least)
        walks = walks.join(deg.select("graph", F.col("node").alias("end"), "degree"), ["graph", "end"])
        ends = walks.groupBy("graph", "u").agg(F.max(F.when(F.col("degree") == 1, F.col("steps"))).alias("a"), F.min(F.when(F.col("degree") > 2, F.col("steps"))).alias("b"))
        own = ends.join(deg.select("graph", F.col("node").alias("u"), "degree"), ["graph", "u"])
        # from an end: itself and the steps to the junction; on the way: the steps either way and itself
        short = ((F.col("degree") == 1) & (F.col("b") + 1 <= least)) | ((F.col("degree") == 2) & (F.col("a") + F.col("b") + 1 <= least))
        gone = saved(own.where(short).select("graph", F.col("u").alias("node")), "gone")
        if gone.isEmpty():
            return edges if settled is None else edges.union(settled)
        left = deg.join(gone, ["graph", "node"], "left_anti").groupBy("graph").agg(F.count("*").alias("left"))
        active = gone.select("graph").distinct().join(left.where(F.col("left") >= keep), "graph", "left_semi")
        active = saved(active, "active")
        done = edges.join(active, "graph", "left_anti")
        settled = saved(done if settled is None else settled.union(done), "settled")
        edges = edges.join(active, "graph", "left_semi")
        for c in "uv":
            edges = edges.join(gone.withColumnRenamed("node", c), ["graph", c], "left_anti")
        edges = saved(edges.select("graph", "u", "v", "w"), "edges")

