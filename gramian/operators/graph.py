"""Connected components of edge tables, as joins and aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.runtime import cut, written


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, linked to the smallest of them.  edges: (u, v), v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked to its smallest neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _joined_in_a_task(it):
    """(u, v): of edges that one task has, each node and the smallest one that it reaches."""
    pairs = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in it]
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    nodes, ends = np.unique(pairs, return_inverse=True)
    least = least_labels(len(nodes), *ends.reshape(-1, 2).T)
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[least])], names=["u", "v"])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges between a and b, the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)  # what a node has found its label finds too
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = 0) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge table reaches.

    Alternates two steps, each one aggregation and one join, that turn every component into a star around
    its smallest node; the number of rounds grows with the logarithm of the component's size.  Minima
    are partial aggregates and joins may be split, so a hub does not land in one task.  Self-loops
    keep their node; nulls on either side are passed over.  Up to ``small`` edges, of whole numbers, are solved in one task instead, to the same end.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    star = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, rounds = None, 0
    if small and star.limit(small + 1).count() <= small:
        star, before = star.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined_in_a_task, "u long, v long"), ()
    while before != ():
        rounds += 1
        star = (cut if rounds % 4 else written)(_small_star(_large_star(star)))
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, value): the greatest value that reaches each node along the edges, its own included."""
    before = None
    while True:
        offered = edges.join(values.select(F.col("node").alias("src"), "value"), "src").select(F.col("dst").alias("node"), "value")
        values = cut(values.unionAll(offered).groupBy("node").agg(F.max("value").alias("value")))
        state = tuple(values.agg(F.sum(F.xxhash64("node", "value").cast("decimal(38,0)"))).first())
        if state == before:
            return values
        before = state


def _doubled(steps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For nodes with one way on, steps (v, to): the tables of ways of 1, 2, 4, ... steps (v, to, least, done), and the last.  A way ends where a node has no
    such step (done).  least: the smallest node on the way, its end left out.  Goes on until every way has ended or runs in a circle whose smallest
    node it has met."""
    ends = steps.select(F.col("v").alias("on"))
    now = cut(steps.join(ends, steps["to"] == ends["on"], "left").select("v", "to", F.col("v").alias("least"), F.col("on").isNull().alias("done")))
    levels, before = [now], None
    while True:
        open_ways = now.where("not done")
        # Where two tables of ways have as many ends these are circles; where the least nodes agree too, whole circles were seen.
        state = tuple(open_ways.agg(F.count_distinct("to"), F.sum(F.xxhash64("v", "least").cast("decimal(38,0)"))).first())
        if not state[0] or state == before:
            return levels, now
        before = state
        on = now.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        further = open_ways.join(on, "to").select("v", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        now = cut(now.where("done").unionByName(further))
        levels.append(now)


class _Chains:
    """Nodes with one edge out, left out of a graph: an edge to one of them goes on to where its way ends.

    Such a node is in the component of its end if, and only if, an edge from a node of that component leads to it or to a node before it on the way.
    A way that runs into a circle never leaves it: the circle is a component, and the nodes before it are alone.
    """

    def __init__(self, edges: DataFrame):
        out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
        steps = cut(out.where("n = 1").select(F.col("src").alias("v"), "to"))
        self.levels, ways = _doubled(steps)
        circular = ways.where("not done")
        on_circle = circular.join(circular.select(F.col("to").alias("v")).distinct(), "v", "left_semi")
        self.circles = cut(on_circle.select(F.col("v").alias("node"), F.col("least").alias("component")))
        self.ways = ways.select("v", "to", "done")
        rest = edges.join(steps.select(F.col("v").alias("src")), "src", "left_anti")
        met = cut(rest.join(self.ways.withColumnRenamed("to", "end"), F.col("dst") == F.col("v"), "left"))
        #: (u, v, end): edges from a node that stays to one that is left out.
        self.entered = met.where("v is not null and done").select(F.col("src").alias("u"), "v", "end")
        self.edges = cut(met.where("v is null or done").select("src", F.coalesce("end", "dst").alias("dst")).where("src <> dst").distinct())

    def members(self, found: DataFrame) -> DataFrame:
        """(node, component) of the nodes that were left out and aren't alone; ``found``: the components of those that stayed."""
        of = lambda col, name: (found.select(F.col("node").alias(col), F.col("component").alias(name)), col, "left")
        named = self.entered.join(*of("u", "cu")).join(*of("end", "ce"))
        hit = cut(named.where(F.coalesce("cu", "u") == F.coalesce("ce", "end")).select("v").distinct())
        if hit.isEmpty():
            return self.circles
        for level in self.levels:  # all nodes after a hit on its way
            ahead = hit.join(level, "v").join(self.ways.select(F.col("v").alias("to")), "to", "left_semi").select(F.col("to").alias("v"))
            hit = cut(hit.unionAll(ahead).distinct())
        inside = hit.join(self.ways.withColumnRenamed("to", "end"), "v").join(*of("end", "ce"))
        return self.circles.unionAll(inside.select(F.col("v").alias("node"), F.coalesce("ce", "end").alias("component")))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between components instead of nodes; ``names``: (node, component) where it isn't the node itself."""
    of = lambda col: names.select(F.col("node").alias(col), F.col("component").alias(f"{col}2"))
    both = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return both.select(F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst")).where("src <> dst").distinct()


def _through(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, component): ``first`` and then ``then``, which names components of the first and other nodes."""
    on = then.select(F.col("node").alias("component"), F.col("component").alias("further"))
    moved = first.join(on, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return moved.unionAll(then.join(first.select("node"), "node", "left_anti"))


def _strong_in_a_task(it):
    """(node, component): of the edges (src, dst) that one task has, the components by a depth-first search, each named after one of its nodes."""
    pairs = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in it]
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist()
    number, low, on_stack, name = [-1] * len(nodes), [0] * len(nodes), [False] * len(nodes), [0] * len(nodes)
    stack, count = [], 0
    for root in range(len(nodes)):
        todo = [(root, first[root])] if number[root] < 0 else []
        while todo:
            v, e = todo.pop()
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                stack.append(v)
                on_stack[v] = True
            elif e > first[v] and on_stack[to[e - 1]]:
                low[v] = min(low[v], low[to[e - 1]])
            if e < first[v + 1]:
                todo.append((v, e + 1))
                if number[to[e]] < 0:
                    todo.append((to[e], first[to[e]]))
            elif low[v] == number[v]:
                while True:
                    w = stack.pop()
                    on_stack[w], name[w] = False, v
                    if w == v:
                        break
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[np.array(name, np.int64)])], names=["node", "component"])


#: So many edges at most are left to one task.
SMALL = 200_000


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component of a directed edge table.

    Nodes that an edge leads to and back are one, as connected components.  Then nodes with one edge out, and those with one edge in, are left out, whole chains and
    trees of them at once: ways are doubled, so that rounds grow with the logarithm of a chain's length.  Both go on as long as they leave out a
    tenth of the edges.  What is left is coloured by the greatest node that reaches each; inside a colour, what reaches that node is
    a component.  Nodes that were left out get theirs in the end, the last ones first.  As soon as ``small`` edges or fewer are left, of whole numbers, one task
    finds their components, to the same end.
    """
    pairs = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    nodes = pairs.select(F.col("src").alias("node")).unionAll(pairs.select("dst")).distinct()
    left, undo = cut(pairs.where("src <> dst")), []
    n = left.count()
    while n > small:
        mutual = left.join(_turned(left), ["src", "dst"], "left_semi").where("src < dst")
        if not mutual.isEmpty():
            one = cut(components(mutual))
            left = cut(_renamed(left, one))
            undo.append(lambda found, one=one: _through(one, found))
        for turn in (False, True):
            chains = _Chains(_turned(left) if turn else left)
            left = _turned(chains.edges) if turn else chains.edges
            undo.append(lambda found, chains=chains: found.unionByName(chains.members(found)))
        now, n = n, left.count()
        if n > 0.9 * now:
            break
    if n <= small and n:
        found = cut(left.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(_strong_in_a_task, "node long, component long"))
    else:
        found = cut(_coloured(left))
    for back in reversed(undo):
        got = back(found)
        # The node that a component is named after is in it.
        found = cut(got.unionAll(got.select(F.col("component").alias("node"), "component")).distinct())
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    named = found.join(least, "component").select("node", F.least("least", "component").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _coloured(left: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``left`` (src, dst) that aren't alone, by colours; a component is named after one of its nodes."""
    done = None
    while True:
        while True:  # nodes without an edge in or out are alone
            inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            n, left = left.count(), cut(inner)
            if left.count() == n:
                break
        if left.isEmpty():
            break
        alive = left.select(F.col("src").alias("node")).distinct()
        c = _spread(alive.select("node", F.col("node").alias("value")), left).withColumnRenamed("value", "colour")
        same = left.join(c.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(c.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        back = cut(same.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _spread(c.select("node", F.when(F.col("node") == F.col("colour"), 1).otherwise(0).alias("value")), back)
        found = cut(reached.where("value = 1").select("node").join(c, "node").select("node", F.col("colour").alias("component")))
        done = found if done is None else done.unionAll(found)
        gone = found.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return done
