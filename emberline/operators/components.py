"""Connected components, inside a task (numpy) and across tasks (Spark)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize, release

#: Edges up to which one task merges them all; beyond, rounds of star contraction do.
ONE_TASK_EDGES = 500_000


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of the component of each of ``n`` nodes under the links ``a[i] - b[i]``.

    ``label``: components known already (each node's is a root, the least member).
    """
    lab = np.arange(n) if label is None else label.copy()
    while True:
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            return lab
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def _merge_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(p["a"].to_numpy(), p["b"].to_numpy()) for p in batches if len(p)]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[components(len(nodes), at[: len(a)], at[len(a) :])]
    yield pd.DataFrame({"node": nodes, "root": root})


def component_roots(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, root`` of every node on an edge ``a, b`` (BIGINT): the least node of its component.

    Up to ``one_task`` distinct edges (counted) a single task merges them.
    Beyond, large-star and small-star rounds alternate, each a partial
    minimum and an equi-join, until the edges no longer change; a hot centre
    is split by adaptive skew joins.  Edges with a NULL end are ignored.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a.alias("a"), b.alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    count = pairs.count()
    if count <= one_task:
        return pairs.coalesce(1).mapInPandas(_merge_in_task, "node long, root long")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        last, pairs = pairs, materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        release(last)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
