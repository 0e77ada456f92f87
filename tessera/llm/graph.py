"""Connected components over edges that may not fit on any one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import joined_hot

#: Edges that one task joins at most.
LOCAL = 1 << 20


def roots(n: int, u: np.ndarray, v: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest node reachable from each of n nodes, by hooking and pointer jumping."""
    p = np.arange(n) if parent is None else parent.copy()
    while True:
        pu, pv = p[u], p[v]
        differ = pu != pv
        if not differ.any():
            return p
        u, v, pu, pv = u[differ], v[differ], pu[differ], pv[differ]
        np.minimum.at(p, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def components(edges: DataFrame, rounds: int = 40, local: int = LOCAL) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node it reaches.

    edges: long columns u and v; loops and repeats are allowed, rows with a null are ignored. Up to `local` edges, 16 MB,
    are joined by one task. More alternate large-star and small-star steps; each step's edges are checkpointed, so that
    lineage stays short and a lost executor repeats one step at most, and a node with a large share of the edges is
    looked up by broadcast, so that its edges stay where they are. Edges never reach the driver, only counts.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if e.count() <= local:
        return e.coalesce(1).mapInArrow(_joined, "node long, root long").checkpoint()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = joined_hot(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = "explode(if(v = m, array(struct(u AS u, m AS v)), array(struct(v AS u, m AS v), struct(u AS u, m AS v)))) AS e"
        e = joined_hot(large, least, "u", "n").selectExpr(small).select("e.u", "e.v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _joined(batches):
    """(node, root) of all edges (u, v)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = nodes[roots(len(nodes), at[: len(u)], at[len(u) :])]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["node", "root"])
