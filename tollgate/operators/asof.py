"""Point-in-time join: each row with what was in force at its time.

Both logs are put on one time line, which is cut into deterministic chunks (see ``prefix``).  Within a chunk the newest value of a key
is carried along its rows; across chunks, a row per chunk and key, the last one found so far.  So a row costs one
exchange and one sort, however many changes its key has seen, and a key with a third of all rows is spread over the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.prefix import with_chunk


def asof_join(rows: DataFrame, changes: DataFrame, key: str, time: str, ties: tuple[str, str], values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with the ``values`` of the newest of ``changes`` of the same ``key`` at or before their ``time``; null where there is none.

    ``ties``: an integer column of the rows (any order within an instant) and one of the changes (the largest of an instant counts).
    Rows or changes without a time or key meet nothing; repeated rows stay repeated.
    """
    own, seq = ties
    # one change a key and instant; combined before the shuffle
    last = (changes.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(key, time)
            .agg(F.max_by(F.struct(*values), F.col(seq)).alias("_value")))
    kind = last.schema["_value"].dataType
    line = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(own).cast("long").alias("_i"), F.lit(1).alias("_row"), F.lit(None).cast(kind).alias("_value"),
                       F.struct(*rows.columns).alias("_own"))
    line = line.unionByName(last.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(-(1 << 62)).alias("_i"), F.lit(0).alias("_row"), "_value",
                                        F.lit(None).cast(line.schema["_own"].dataType).alias("_own")))
    line = with_chunk(line, ["_t", "_i"], partitions)
    carried = Window.partitionBy("_chunk", "_k").orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = line.withColumn("_here", F.last("_value", ignorenulls=True).over(carried)).where("_row = 1")
    # a row per chunk and key
    ends = line.groupBy("_chunk", "_k").agg(F.max_by("_value", F.when(F.col("_row") == 0, F.col("_t"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("_chunk", "_k", F.last("_end", ignorenulls=True).over(before).alias("_before")).where("_before is not null")
    out = within.join(earlier, ["_chunk", "_k"], "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    return out.select("_own.*", *(found[v].alias(v) for v in values))
