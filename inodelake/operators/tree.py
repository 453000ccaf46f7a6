"""Paths and directories over an edge table dirents (parent_id, slot, inode_id, name, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inodelake import layout
from inodelake.runtime import free_name, with_rank, with_running, written


def path_parts(path: Column) -> Column:
    """Components of a path: empty ones and ``.`` are dropped, ``..`` is a name like any other."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def parent_and_name(path: Column) -> tuple[Column, Column]:
    """The parent's path and the last component; null for a path without components."""
    parts = path_parts(path)
    n = F.size(parts)
    return F.when(n > 0, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), "/")), F.when(n > 0, F.try_element_at(parts, F.lit(-1)))


def lookup_first(dirents: DataFrame) -> DataFrame:
    """parent_id, name, inode_id of the first entry by slot, and how many have the name."""
    return dirents.groupBy("parent_id", "name").agg(F.min_by("inode_id", "slot").alias("inode_id"), F.count(F.lit(1)).alias("entries"))


def list_directory(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """parent_id, slot, name, kind and size of every entry that has an inode (inode_id, size)."""
    return dirents.join(inodes.select("inode_id", "size"), "inode_id").select("parent_id", "slot", "name", "kind", "size")


def walk(dirents: DataFrame, root: str | None = None, roots: DataFrame | None = None) -> DataFrame:
    """path, inode_id, kind, depth and slots (pre-order key) of everything below ``root``, level by level.

    With ``roots`` (root, path), everything below each of them, with its root; paths begin with the root's own.
    A level is written before the next is joined, so neither the number of rows
    nor the depth is held in one plan. A directory that is its own descendant is an error.
    """
    spark = dirents.sparkSession
    many = roots is not None
    above = roots.select("root", F.col("path").alias("above")) if many else spark.createDataFrame([(root, "")], "root string, above string")
    above = above.select("root", "above", F.col("root").alias("parent_id"), F.array().cast("array<long>").alias("before"))
    path = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat_ws("/", "above", "name"))
    levels, depth, most = [], 0, None
    while True:
        depth += 1
        level = dirents.join(above, "parent_id").select("root", path.alias("path"), "inode_id", "kind", F.lit(depth).alias("depth"), F.concat("before", F.array("slot")).alias("slots"))
        levels.append(written(level, "level"))
        if depth > 1 and not levels[-1].take(1):
            break
        if depth > 64:  # no path without a circle is longer than there are directories
            most = most or dirents.select("parent_id").distinct().count()
            if depth > most:
                raise RecursionError("a directory is below itself")
        above = levels[-1].where("kind = 'd'").select("root", F.col("path").alias("above"), F.col("inode_id").alias("parent_id"), F.col("slots").alias("before"))
    found = levels[0]
    for level in levels[1:-1]:
        found = found.union(level)
    return found if many else found.drop("root")


def resolve(requests: DataFrame, dirents: DataFrame, root: str) -> DataFrame:
    """``requests`` (path, ...) with inode_id: one join per component, null where a component is missing or the path is null; the root for a path without components."""
    parts, at, of, step = (free_name(n, *requests.columns) for n in ("__parts", "__at", "__of", "__next"))
    # a table of its own, so that Spark can split the rows that share a first component
    first = written(lookup_first(dirents).select(F.col("parent_id").alias(at), F.col("name").alias(of), F.col("inode_id").alias(step)), "first")
    found = requests.withColumn(parts, path_parts(F.col("path"))).withColumn("inode_id", F.when(F.col("path").isNotNull(), F.lit(root)))
    longest = found.agg(F.max(F.size(parts)).alias("n")).first()["n"] or 0
    for k in range(longest):
        on = (F.col("inode_id") == F.col(at)) & (F.try_element_at(parts, F.lit(k + 1)) == F.col(of))
        found = found.join(first, on, "left").withColumn("inode_id", F.when(F.size(parts) > k, F.col(step)).otherwise(F.col("inode_id"))).drop(at, of, step)
        if k % 8 == 7:  # long paths don't pile up in one plan
            found = written(found, "resolved")
    return found.drop(parts)


def kinds(dirents: DataFrame, root: str) -> DataFrame:
    """of and kind of every inode that an entry names, and of the root."""
    named = dirents.groupBy(F.col("inode_id").alias("of")).agg(F.min("kind").alias("kind"))
    return named.union(dirents.sparkSession.createDataFrame([(root, "d")], "of string, kind string"))


def outcomes(requests: DataFrame, dirents: DataFrame, root: str) -> DataFrame:
    """``requests`` (path, ...) with inode_id, kind and outcome: ok, not found, or not a directory (something is looked for below a file)."""
    found = resolve(requests, dirents, root)
    parts = path_parts(F.col("path"))
    found = found.join(kinds(dirents, root), F.col("inode_id") == F.col("of"), "left").drop("of")
    # where a path was lost: the longest prefix that is there tells why
    lost = found.where("inode_id is null and path is not null").select("path").distinct()
    prefixes = lost.select(F.col("path").alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("path")))).alias("p"))
    there = resolve(prefixes.select("whole", "p.n", "p.path"), dirents, root).where("inode_id is not null")
    last = there.groupBy("whole").agg(F.max_by("inode_id", "n").alias("at")).join(kinds(dirents, root), F.col("at") == F.col("of")).select("whole", F.col("kind").alias("blocker"))
    told = found.join(last, F.col("path") == F.col("whole"), "left")
    outcome = F.when(F.col("inode_id").isNotNull(), "ok").when(F.col("blocker") == "f", "not a directory").otherwise("not found")
    return told.withColumn("outcome", outcome).drop("whole", "blocker")


def listing(dirents: DataFrame, inodes: DataFrame, requests: DataFrame, root: str, recursive: bool = False) -> DataFrame:
    """target, name, kind, size, comp_size and modified for what each of ``requests`` (path) lists.

    A directory lists its entries (with ``recursive`` all below it), a file itself; a path that is
    not there lists nothing. ``inodes``: inode_id, size, compressed_size, modified_at (seconds). comp_size is null for
    what is stored as it is.
    """
    asked = outcomes(requests.select("path").where("path is not null").distinct(), dirents, root).where("outcome = 'ok'")
    asked = written(asked.select(F.array_join(path_parts(F.col("path")), "/").alias("target"), "inode_id", "kind").distinct(), "asked")
    below = asked.where("kind = 'd'").select(F.col("inode_id").alias("root"), F.lit("").alias("path")).distinct()
    if recursive:
        found = walk(dirents, roots=below)
    else:
        found = dirents.join(below, F.col("parent_id") == F.col("root")).select("root", F.col("name").alias("path"), "inode_id", "kind")
    found = asked.where("kind = 'd'").select("target", F.col("inode_id").alias("root")).join(found.select("root", "path", "inode_id", "kind"), "root")
    name = F.when(F.col("target") == "", F.col("path")).otherwise(F.concat_ws("/", "target", "path"))
    rows = found.select("target", name.alias("name"), "inode_id", "kind").union(asked.where("kind = 'f'").select("target", F.col("target").alias("name"), "inode_id", "kind"))
    about = inodes.select("inode_id", "size", F.expr("nullif(compressed_size, 0)").alias("comp_size"), F.date_format(F.timestamp_seconds("modified_at"), "yyyy-MM-dd HH:mm:ss").alias("modified"))
    return rows.join(about, "inode_id").select("target", "name", "kind", "size", "comp_size", "modified")


def delete(dirents: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (parent_id, name) with inode_id and outcome: deleted, not found, or not empty (a directory with entries).

    Requests that repeat are answered once. A name stands for its first entry.
    """
    asked = requests.select("parent_id", "name").distinct()
    first = lookup_first(dirents).select("parent_id", "name", "inode_id")
    found = asked.join(first, ["parent_id", "name"], "left")
    held = dirents.select(F.col("parent_id").alias("of")).distinct()
    found = found.join(held, F.col("inode_id") == F.col("of"), "left")
    outcome = F.when(F.col("inode_id").isNull(), "not found").when(F.col("of").isNotNull(), "not empty").otherwise("deleted")
    return found.select("parent_id", "name", "inode_id", outcome.alias("outcome"))


def create_entries(dirents: DataFrame, requests: DataFrame) -> DataFrame:
    """The entries that ``requests`` (parent_id, name, inode_id, kind) add, at the slots after the directory's last.

    A name that the directory has already, that is too long or holds a slash is not
    added; of requests with one name the smallest inode_id is.
    """
    valid = requests.where((F.octet_length("name") <= layout.NAME_BYTES) & ~F.contains("name", F.lit("/")))
    first = valid.groupBy("parent_id", "name").agg(F.min_by(F.struct("inode_id", "kind"), "inode_id").alias("one")).select("parent_id", "name", "one.*")
    new = first.join(dirents.select("parent_id", "name"), ["parent_id", "name"], "left_anti")
    last = dirents.groupBy("parent_id").agg(F.max("slot").alias("last"))
    ranked = with_rank(new, ["parent_id"], [F.col("inode_id")])
    return ranked.join(last, "parent_id", "left").select("parent_id", (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"), "inode_id", "name", "kind")


def capacity(entries: DataFrame) -> DataFrame:
    """parent_id, entries, fitting and bytes_used: how many of a directory's entries (parent_id, slot, name) fit into its one block."""
    sized = entries.select("parent_id", "slot", (F.octet_length("name") + layout.ENTRY_HEAD).alias("bytes"))
    placed = with_running(sized, ["parent_id"], [F.col("slot")], F.col("bytes"), "upto")
    fits = F.col("upto") <= layout.BLOCK
    return placed.groupBy("parent_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(fits).alias("fitting"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).cast("long").alias("bytes_used"))
