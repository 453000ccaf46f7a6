"""Pairs of blocks of a cluster that are compared with each other, so that each pair of members meets once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.runtime import written

#: What tells the two blocks of a pair, and with them the group that is compared in one task.
PAIR = ("cluster", "one", "lo", "two", "hi")


def paired(members: DataFrame, key: str, size: int, near: Sequence[int] = (0,)) -> DataFrame:
    """``members`` (cluster, ``key``, core, band, ...) once for each pair of blocks that they take part in, with one, lo, two, hi and second.

    A cluster is cut by core and band, and those parts into blocks of about ``size`` members. A
    block meets those of its cluster whose band differs by a number in ``near``; blocks of the core don't meet each
    other. ``second`` tells the members of the pair's second block; in a pair of a block with itself there are none.
    """
    code = F.col("band") * 2 + F.col("core").cast("int")
    rows = members.withColumn("code", code.cast("long"))
    counts = rows.groupBy("cluster", "code").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    # a few bands a cluster; tables of their own, so that Spark can split a large cluster's members in the joins with them
    maps = counts.groupBy(F.col("cluster").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("code", "blocks"))).alias("blocks"))
    maps = written(maps, "bands")
    rows = rows.join(maps, F.col("cluster") == F.col("of"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")[F.col("code")]).cast("int"))
    targets = F.array(*[((F.col("band") + d) * 2 + c).cast("long") for d in near for c in (0, 1)])
    targets = F.filter(targets, lambda t: ~F.col("core") | (F.pmod(t, F.lit(2)) == 0))
    codes, own = F.col("code"), F.col("own")

    def pair(t, x):
        mine = (codes < t) | ((codes == t) & (own <= x))
        ends = lambda a, b, name: F.when(mine, a).otherwise(b).alias(name)
        return F.struct(ends(codes, t, "one"), ends(own, x, "lo"), ends(t, codes, "two"), ends(x, own, "hi"), (~mine).alias("second"))

    numbers = lambda t: F.filter(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("blocks")[t], F.lit(0)) - 1, F.lit(0))), lambda x: x < F.coalesce(F.col("blocks")[t], F.lit(0)))
    pairs = F.flatten(F.transform(targets, lambda t: F.transform(numbers(t), lambda x: pair(t, x))))
    return rows.withColumn("pair", F.explode(pairs)).select(*members.columns, *[f"pair.{c}" for c in ("one", "lo", "two", "hi", "second")])


def core_links(members: DataFrame, key: str) -> DataFrame:
    """``key``, links and root for the members (cluster, ``key``, n, core) of each cluster's core, which are all linked with each other."""
    core = members.where("core")
    whole = core.groupBy(F.col("cluster").alias("of")).agg(F.sum("n").alias("whole"))
    return core.join(written(whole, "weights"), F.col("cluster") == F.col("of")).select(key, (F.col("whole") - F.col("n")).alias("links"), F.col("cluster").alias("root")).where("links > 0")
