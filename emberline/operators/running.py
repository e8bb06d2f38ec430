"""Running sums along an order, however hot a group is.

A window over a group sorts the whole group in one task.  Here the rows are
sorted by range over (group, order), so a hot group spreads over many tasks;
each keeps running sums of its own, and the sums of the parts before are added
as offsets.  Only the groups at the two ends of a part can go on in another,
so the table of offsets has at most two rows a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def _along(sums: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        g = t.column("g__").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([first, [len(g)]]))
        group = np.repeat(np.arange(len(first)), size)
        t = t.drop_columns(["g__"])
        t = t.append_column("part__", pa.array(np.full(len(g), TaskContext.get().partitionId(), "int32")))
        t = t.append_column("edge__", pa.array((group == 0) | (group == len(first) - 1)))
        for i in range(sums):
            v = t.column(f"s{i}__").to_numpy()
            all_ = np.cumsum(v)
            before = np.concatenate([[0], all_])[first].astype(v.dtype)
            upto = all_ - np.repeat(before, size)
            t = t.append_column(f"u{i}__", pa.array(upto)).append_column(f"t{i}__", pa.array(np.repeat(upto[first + size - 1], size)))
        yield from t.drop_columns([f"s{i}__" for i in range(sums)]).to_batches()

    return run


def running_totals(df: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` with ``upto_<s>`` (sum of the group's rows up to and with this one) and ``total_<s>`` for each column in ``sums``.

    ``order`` should tell the rows of a group apart; rows that tie follow each
    other in any order.  The summed columns are BIGINT or DOUBLE; NULLs in
    them count as 0.  A NULL group is a group; without groups all rows are one.
    One exchange by range and one written table; a task holds its part.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(F.lit(0), *(x for g in groups for x in (F.col(g).isNull(), F.col(g))))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = {s: "double" if kinds[s] in ("double", "float") else "bigint" for s in sums}
    rows = df.select("*", key.alias("g__"), *(F.coalesce(F.col(s).cast(kind[s]), F.lit(0).cast(kind[s])).alias(f"s{i}__") for i, s in enumerate(sums)))
    by = [*(F.col(g) for g in groups), F.col(order).desc() if descending else F.col(order)]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", part__ int, edge__ boolean" + "".join(f", u{i}__ {kind[s]}, t{i}__ {kind[s]}" for i, s in enumerate(sums))
    run = materialize(ranged.mapInArrow(_along(len(sums)), schema), "running")
    ends = run.where("edge__").groupBy(*groups, "part__").agg(*(F.max(f"t{i}__").alias(f"e{i}__") for i in range(len(sums))))
    whole = Window.partitionBy(*(groups or [F.lit(1)]))
    before = whole.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        *(F.col(g).alias(f"k{j}__") for j, g in enumerate(groups)), F.col("part__").alias("p__"),
        *(F.coalesce(F.sum(f"e{i}__").over(before), F.lit(0)).alias(f"o{i}__") for i in range(len(sums))), *(F.sum(f"e{i}__").over(whole).alias(f"w{i}__") for i in range(len(sums))),
    )
    on = (F.col("part__") == F.col("p__")) & F.col("edge__")
    for j, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"k{j}__"))
    out = run.join(F.broadcast(offsets), on, "left")  # at most two rows a part
    added = [x for i, s in enumerate(sums) for x in ((F.col(f"u{i}__") + F.coalesce(f"o{i}__", F.lit(0))).alias(f"upto_{s}"), F.coalesce(f"w{i}__", f"t{i}__").alias(f"total_{s}"))]
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *added)
