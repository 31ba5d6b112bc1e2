"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, scratch, written

#: Edges (16 bytes each) up to which one task finds the components; more are worked on by all executors.
ONE_TASK = 20_000


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a graph's vertices and the least id of each one's component."""
    ids, code = np.unique(np.r_[u, v], return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        # Lower the labels of both ends and of what they are hooked to, then follow pointers.
        for at in (a, b, before[a], before[b]):
            np.minimum.at(label, at, least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return ids, ids[label]


def in_one_task(edges: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for b in batches:
            u.append(b.column("u").to_numpy())
            v.append(b.column("v").to_numpy())
        if u:
            yield pa.record_batch([pa.array([np.concatenate(x).astype(np.int64).tobytes()], pa.binary()) for x in (u, v)], ["u", "v"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
        if rows:
            ids, component = labels_of(*(np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in (0, 1)))
            for i in range(0, len(ids), 50_000):
                yield pa.record_batch([pa.array(ids[i : i + 50_000]), pa.array(component[i : i + 50_000])], ["id", "component"])

    return edges.mapInArrow(pack, "u binary, v binary").repartition(1).mapInArrow(solve, "id long, component long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component, its least reachable id, for every id of edges (a, b).

    Every vertex hooks to its least neighbour, pointers jump to their end, and edges are drawn anew between what the
    vertices have become, loops and repeats dropped; so the graph shrinks at least by half in each round, until no edge is
    left. Hooks go down only, so a vertex ends at the least id of its component. Each round is written. A graph of at most
    ONE_TASK edges is solved in one task instead.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), path := scratch(spark, "edges"))
    if left.count() <= ONE_TASK:
        labels = written(in_one_task(left), scratch(spark, "components"))
        dropped(spark, path)
        return labels
    labels: DataFrame | None = None
    old: list[str] = []
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")).select(F.col("u").alias("id"), "to"), new := scratch(spark, "components"))
        old.append(new)
        while True:
            end = hook.select(F.col("id").alias("of"), F.col("to").alias("end"))
            jumped = written(hook.join(end, F.col("to") == F.col("of")).select("id", F.col("to").alias("was"), F.col("end").alias("to")), new := scratch(spark, "components"))
            old.append(new)
            moved = not jumped.where("was <> to").isEmpty()
            hook = jumped.select("id", "to")
            if not moved:
                break
        x, y = (hook.select(F.col("id").alias(f"{c}_"), F.col("to").alias(c)) for c in ("x", "y"))
        drawn = left.join(x, F.col("u") == F.col("x_")).join(y, F.col("v") == F.col("y_")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()
        left = written(drawn, new := scratch(spark, "edges"))
        dropped(spark, path)
        path = new
        if labels is None:
            labels = hook.select("id", F.col("to").alias("component"))
        else:
            labels = labels.join(hook.select(F.col("id").alias("of"), "to"), F.col("component") == F.col("of"), "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = written(labels, scratch(spark, "components"))
        dropped(spark, *old)
        old = []
    return labels
