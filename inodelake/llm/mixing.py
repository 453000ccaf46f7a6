"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.runtime import free_name, table, with_rank, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of every source in ``sizes`` (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and
    divide ``share`` of all sizes; a target stops at ``most`` times its source's
    size and the rest goes to the others by weight until none is above.
    """
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = with_rank(totals, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    sources = written(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * F.lit(most)
    level, capped = None, -1
    while True:  # one row comes back each time; every round but the last has found another source at its limit
        over = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        got = sources.agg(
            (F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).alias("all"),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if got["capped"] == capped or not got["weight"]:
            break
        capped = got["capped"]
        level = (float(got["all"]) - got["full"]) / got["weight"]
    return sources.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level or 0.0)).alias("target"))


def plan_mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, order: tuple[str, ...] | None = None) -> DataFrame:
    """How often the mix takes each document: ``keep``, size, source_size, target, copies, taken.

    Size is the number of words (null, empty and blank texts: 0), however long the text is. Every document of a source
    expects target / source_size copies; summed along the source's documents in
    order of size and then of the columns ``order`` (``keep`` unless given), shifted by one random offset a source drawn from ``seed``, a
    document is taken once per whole number that its sum passes. In that order the
    words taken differ from the target by less than two of the source's longest
    documents. Null sources are one source. Rows that are equal in size and
    ``order`` are taken apart, in any order. An empty table gives no rows. Other
    columns are ignored; ``keep`` may not have a name of the columns returned beside it.
    """
    own = {"source", "size", "source_size", "target", "copies", "taken"}
    if clash := own & {k.lower() for k in keep}:
        raise ValueError(f"kept columns may not be named {sorted(clash)}")
    rest = [k for k in order or keep if k not in keep]
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select(*keep, *rest, "source", size.alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    rank = with_rank(sizes, ["source"], [F.col("size"), *[F.col(k) for k in order or keep]], "rank")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    offset = F.conv(F.substring(part, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = rank.join(targets, rank["source"].eqNullSafe(targets["of"])).withColumn("each", expected).withColumn("from", offset)
    copies = F.floor(F.col("each") * F.col("rank") + F.col("from")) - F.floor(F.col("each") * (F.col("rank") - 1) + F.col("from"))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan_mix`` takes it.

    Documents of one size are taken in the order of a hash of all their columns, so the
    rows taken don't depend on the order of ``docs``; rows that are equal in everything
    can't be told apart. Columns may have any names; nulls, odd texts and empty tables are as in ``plan_mix``.
    """
    row, content, times, copy = (free_name(n, *docs.columns) for n in ("__row", "__content", "__copies", "__copy"))
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes])
    rows = written(docs.withColumn(content, whole).withColumn(row, F.monotonically_increasing_id()), "rows")
    plan = plan_mix(rows, keep=(row,), order=(content,), **how).where("copies > 0").select(F.col(row).alias(copy), F.col("copies").alias(times))
    taken = rows.join(plan, F.col(row) == F.col(copy)).drop(copy).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return taken.select(*[f"`{c}`" for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return plan_mix(table(spark, sf_dir, "documents")).drop("source")


OP10_SQL = f"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS MATERIALIZED (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM totals
), levels AS (
  SELECT 0 AS round, (SELECT sum(source_size) * {SHARE}::DOUBLE / sum(weight) FROM weighed) AS level
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) * {SHARE}::DOUBLE - coalesce(sum(source_size * {MOST}::DOUBLE) FILTER (source_size * {MOST}::DOUBLE < weight * level), 0))
                     / sum(weight) FILTER (source_size * {MOST}::DOUBLE >= weight * level) FROM weighed)
  FROM levels WHERE round < (SELECT count(*) FROM weighed) AND level IS NOT NULL
), final AS (
  SELECT max(level) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(source_size * {MOST}::DOUBLE, weight * level) AS target FROM weighed, final
), ranked AS (
  SELECT s.*, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
         ('0x' || substr(md5('{SEED}' || coalesce('=' || s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, (floor(each * rank + start) - floor(each * (rank - 1) + start))::BIGINT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied
"""
