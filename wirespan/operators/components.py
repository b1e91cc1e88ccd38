"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.sources.tables import shared_table

#: So many links are joined in one task.
SMALL = 1 << 16
#: Links that a task holds at a time.
SLICE = 1 << 18
SALTS = 16


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b of the vertices 0 to n - 1: each vertex's root, the least of its component, and the places of links that join all.

    By rounds over whole arrays: every root with a link to a smaller one goes under the least of these, by one link, and
    then all vertices move up to their roots.
    """
    root = np.arange(n)
    used = [np.zeros(0, np.int64)]
    at = np.arange(len(a))
    while True:
        x, y = root[a[at]], root[b[at]]
        apart = x != y
        at, high, low = at[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(at):
            return root, np.concatenate(used)
        order = np.lexsort((low, high))
        first = order[np.diff(high[order], prepend=-1) != 0]
        root[high[first]] = low[first]
        used.append(at[first])
        while not (root[root] == root).all():
            root = root[root]


def _forests(batches):
    """Links (root, v) to a forest of the same form, in which every vertex has a link to its root (a root to itself).

    A task's forest is folded with what comes next until it has more than half a SLICE, and then leaves; a vertex may so
    get several roots, even in one task.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def fold() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        kind = table.schema.field(0).type
        a, b = (table.column(k).to_numpy() for k in (0, 1))
        names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        root, _ = forest(number[: len(a)], number[len(a) :], len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[root], kind), pa.array(names, kind)], ["root", "v"])

    for batch in batches:
        for begin in range(0, len(batch), SLICE):
            held.append(batch.slice(begin, SLICE))
            rows += len(held[-1])
            if rows >= SLICE:
                folded = fold()
                held, rows = [folded], len(folded)
                if rows > SLICE // 2:
                    yield folded
                    held, rows = [], 0
    if rows:
        yield fold()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every vertex of the edges; a component is named by its least vertex.

    Tasks first join what their own edges join, however these lie, to forests of a bounded size; then each vertex meets
    all its partial roots, of which there are at most as many as forests, and goes under the least. What is left are links
    between roots, a graph that is smaller with each level, until it has at most SMALL. Null ends are ignored, self-loops
    keep their vertex.
    """
    edges = edges.select(F.col(a).alias("root"), F.col(b).alias("v")).where("root is not null and v is not null")
    kind = edges.schema["v"].dataType.simpleString()
    fields = f"root {kind}, v {kind}"
    partial = shared_table(edges.mapInArrow(_forests, fields))
    if partial.count() <= SMALL:
        return partial.repartition(1).mapInArrow(_forests, fields).select("v", F.col("root").alias("component"))
    met = shared_table(partial.groupBy("v").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    links = shared_table(met.select("root", F.explode("roots").alias("v")).where("root != v").distinct())
    labels = met.select("v", "root")
    if not links.limit(1).count():
        return labels.select("v", F.col("root").alias("component"))
    above = connected_components(links, "root", "v").select(F.col("v").alias("root"), "component")
    # Few roots have links; of vertices under one there may be very many, so large groups are dealt over tasks.
    counted = shared_table(labels.groupBy("root").agg(F.count("*").alias("n")).join(above, "root"))
    heavy = counted.where("n > 1000").select("root", F.lit(True).alias("heavy"))
    if heavy.limit(1).count():
        salt = F.explode(F.when(F.col("n") > 1000, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        labels = labels.join(heavy, "root", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.hash("v"), F.lit(SALTS))).otherwise(F.lit(0))).drop("heavy")
        named = labels.join(counted.withColumn("salt", salt), ["root", "salt"], "left")
    else:
        named = labels.join(counted, "root", "left")
    return named.select("v", F.coalesce("component", "root").alias("component"))
