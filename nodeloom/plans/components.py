"""Connected components by contraction to the roots of pointer trees.

Each round every node points to its smallest neighbour if that is smaller than itself. The pointers
form trees whose roots are smaller than all their neighbours; pointer doubling (each node takes its
pointer's pointer until none moves) brings every node to its root, and edges are renamed to the
roots of their ends, loops and repeats dropped.

Rounds: let m be a root with a neighbour r whose root is another one. That root is at most r's
smallest neighbour, so smaller than m, and after renaming it is m's neighbour: m points on in the
next round. A root that is left after two rounds has therefore drawn in all its neighbours, at least
one node. So two rounds at least halve the nodes, whatever the order of the ids, and a path in id order
ends in one round with as many doublings as its length has bits.

No join has a component's label as its key before the component is done; a hub only ever meets a
minimum (combined before the shuffle), and both sides of every join are written tables, so adaptive
execution can split a hot node's rows. The roots of all rounds are then followed for every node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nodeloom.plans.store import Saved, save


def _to_roots(pointers: Saved) -> Saved:
    """(node, to) with ``to`` the root of each node's tree; ``pointers`` holds no roots and is dropped."""
    while True:
        step = pointers.df
        further = step.toDF("to", "_further")
        seen = Observation()
        hop = step.join(further, "to", "left").observe(seen, F.count("_further").alias("moved"))
        doubled = save(hop.select("node", F.coalesce("_further", "to").alias("to")), "cc_double")
        pointers.drop()
        pointers = doubled
        if not seen.get["moved"]:
            return pointers


def _renamed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(roots.toDF(end, f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return edges.select("a", "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> Saved:
    """(node, label) for every node of ``edges`` (a, b) that has a neighbour; the label is its component's least node."""
    both = edges.select("a", "b").filter("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    held, rounds = save(both, "cc_edges"), []
    nodes = held
    while held.rows:
        least = held.df.groupBy("a").agg(F.min("b").alias("to")).filter("to < a").withColumnRenamed("a", "node")
        roots = _to_roots(save(least, "cc_step"))
        rounds.append(roots)
        after = save(_renamed(held.df, roots.df), "cc_edges")
        if held is not nodes:
            held.drop()
        held = after
    # One plan: from the second round on the tables are small next to the nodes.
    label = nodes.df.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for roots in rounds:
        label = label.join(roots.df.toDF("label", "_to"), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    done = save(label, "cc")
    for table in {id(t): t for t in (nodes, held, *rounds)}.values():
        table.drop()
    return done
