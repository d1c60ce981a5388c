"""Connected components over edges ``(u BIGINT, v BIGINT)`` by two methods.

``star_components``: alternating large-star and small-star. ``peeled_components``: breadth-first search from the
vertex of highest degree, whose component is taken out of the graph, then minimum propagation with pointer
jumping over what is left.

Both pre-aggregate per vertex before any shuffle of edges, never gather the neighbours of a vertex in one
place, join on vertices with ``keyed_join`` (a vertex may have any number of neighbours), and write every round to
the shared folder. Null ends, self loops and repeated edges tie nothing and are dropped. An empty edge table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import hot_keys, keyed_join
from ..storage import Scratch


def _clean(edges: DataFrame) -> DataFrame:
    """Edges with u > v, each once."""
    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v")
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _facts() -> dict:
    """Number and fingerprint of edges, which tell whether a round changed anything."""
    return {"n": F.count("*"), "mark": F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))}


def star_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component, n)`` of every vertex that has an edge; ``component`` is the smallest id tied to it,
    ``n`` is 0 for roots and 1 for others.

    Large-star links the larger neighbours of a vertex to the least of its neighbourhood, small-star the smaller
    ones and the vertex itself; both only ever shrink the sum of ids, and the fixed point is a forest of stars.
    """
    e, state = scratch.measured(_clean(edges), "edges", **_facts())
    while state["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, f = scratch.measured(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum(F.expr("int(v > u)")).alias("n")), "least", most=F.max("n"))
        hot = hot_keys(least, "u", state["n"], "n", f["most"])
        # large-star: rows (small end s, large end g), m of the small end
        up = e.select(F.col("v").alias("u"), F.col("u").alias("g"))
        large = keyed_join(up, least.select("u", "m"), "u", hot).where("g <> m").select(F.col("g").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        scratch.drop(least)
        # small-star: m is the least smaller neighbour of the larger end
        down, f = scratch.measured(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "down", most=F.max("n"), total=F.sum("n"))
        hot = hot_keys(down, "u", f["total"] or 0, "n", f["most"] or 0)
        links = keyed_join(large, down.select("u", "m"), "u", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = links.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        was = state
        e, state = scratch.measured(nxt, "edges", e, **_facts())
        scratch.drop(large)
        scratch.drop(down)
        if was == state:
            break
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"), F.lit(1).alias("n")).unionByName(roots.select("id", F.col("id").alias("component"), F.lit(0).alias("n")))


def peeled_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 12) -> DataFrame:
    """``(id, component)`` of every vertex that has an edge; ``component`` is the smallest id tied to it.

    Frontiers meet the edges by ``keyed_join``, so a hub's edges never move. Edges of vertices that were visited are left out of
    the table as soon as they make up a quarter of it. The search stops early after ``max_rounds`` frontiers (a giant
    component is shallow; a long chain isn't one): what it reached is then contracted to one vertex, so the propagation
    that follows stays exact.
    """
    e = _clean(edges)
    both, f = scratch.measured(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both", total=F.count("*"))
    total = f["total"]
    degree, f = scratch.measured(both.groupBy("u").agg(F.count("*").alias("n")), "degree", top=F.max(F.struct(F.col("n"), (-F.col("u")).alias("v"))))
    if not total:
        return degree.select(F.col("u").alias("id"), F.col("u").alias("component"))
    most, seed = f["top"]["n"], -f["top"]["v"]
    hubs = hot_keys(degree, "u", total, "n", most)
    # each edge knows the degree of its far end, so a frontier knows how many edges it will visit
    graph = scratch.keep(keyed_join(both, degree.select(F.col("u").alias("v"), F.col("n").alias("d")), "v", hubs).select("u", "v", "d"), "graph", both)
    seen = frontier = degree.sparkSession.range(seed, seed + 1).select(F.col("id").alias("u"), F.lit(most).alias("d"))
    left, visited, whole = total, most, False
    for _ in range(max_rounds):
        step = keyed_join(graph, frontier.select("u"), "u", hubs, "left_semi").groupBy(F.col("v").alias("u")).agg(F.min("d").alias("d"))
        frontier, f = scratch.measured(step.join(seen.select("u"), "u", "left_anti"), "frontier", n=F.count("*"), d=F.sum("d"))
        if not f["n"]:
            whole = True
            break
        if visited * 4 > left:
            graph = scratch.keep(keyed_join(graph, seen.select("u"), "u", hubs, "left_anti"), "graph", graph)
            left, visited = left - visited, 0
        seen = seen.unionByName(frontier)
        visited += f["d"]
    seen, f = scratch.measured(seen.select("u"), "giant", root=F.min("u"))
    root = f["root"]
    rest = keyed_join(graph, seen, "u", hubs, "left_anti").select("u", "v")
    if whole:
        part = rest
    else:  # edges into what was reached lead to its one vertex
        inside = seen.select(F.col("u").alias("v"), F.lit(root).alias("r"))
        to = keyed_join(rest, inside, "v", hubs, "left").select("u", F.coalesce("r", "v").alias("v")).distinct()
        to = scratch.keep(to, "rest")
        part = to.unionByName(to.where(F.col("v") == root).select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = _minimum_labels(part, scratch)
    if whole:
        giant = seen.select(F.col("u").alias("id"), F.lit(root).alias("component"))
    else:
        at = labels.where(F.col("id") == root).select(F.col("component").alias("r"))
        giant = seen.join(F.broadcast(at), how="left").select(F.col("u").alias("id"), F.coalesce("r", F.lit(root)).alias("component"))
        labels = labels.where(F.col("id") != root)
    scratch.drop(graph)
    return labels.select("id", "component").unionByName(giant)


def _minimum_labels(both: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)``: the least id of each vertex's component, from symmetric edges (u, v).

    Every vertex takes the least id of its neighbourhood, twice over the label's own label; vertices with one
    label become one vertex, so the edge table shrinks geometrically, chains included. The labels of the rounds
    are put together from the last (smallest) to the first.
    """
    levels: list[tuple[DataFrame, int]] = []
    e = scratch.keep(both, "edges")
    while True:
        first = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"), F.count("*").alias("n"))
        lab, f = scratch.measured(first, "labels", total=F.sum("n"), most=F.max("n"), vertices=F.count("*"))
        if not f["total"]:
            break
        hubs = hot_keys(lab, "u", f["total"], "n", f["most"])
        for _ in range(2):
            up = lab.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            lab = scratch.keep(keyed_join(lab.select("u", "p"), up, "p", hot_keys(lab, "p", f["vertices"])).select("u", F.col("pp").alias("p")), "labels", replaces=lab)
        one = keyed_join(e, lab, "u", hubs).select(F.col("p").alias("a"), "v")
        two = keyed_join(one, lab.select(F.col("u").alias("v"), F.col("p").alias("b")), "v", hubs)
        e = scratch.keep(two.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges", replaces=e)
        levels.append((lab, f["vertices"]))
    out = lab.select(F.col("u").alias("id"), F.col("p").alias("component"))
    for lab, n in reversed(levels):
        up = out.select(F.col("id").alias("p"), F.col("component").alias("c"))
        out = scratch.keep(keyed_join(lab, up, "p", hot_keys(lab, "p", n), "left").select(F.col("u").alias("id"), F.coalesce("c", "p").alias("component")), "out")
        scratch.drop(lab)
    return out
