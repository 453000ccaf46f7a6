import pytest

from inodelake.operators import tree

ENTRY = "parent_id string, slot long, inode_id string, name string, kind string"


@pytest.fixture(scope="module")
def dirents(spark):
    rows = [("root", 0, "a", "a", "d"), ("root", 1, "x", "x", "f"), ("a", 0, "b", "b", "d"), ("b", 0, "f", "file.txt", "f"), ("b", 1, "g", "file.txt", "f"), ("a", 1, "dots", "..", "f")]
    return spark.createDataFrame(rows, ENTRY)


def test_parts_parents_and_names(spark):
    from pyspark.sql import functions as F

    paths = ["a/b/file.txt", "/a//./b/", "", "/", ".", "x", "a/../b"]
    parent, name = tree.parent_and_name(F.col("path"))
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", parent, name).collect()}
    assert got == {"a/b/file.txt": ("a/b", "file.txt"), "/a//./b/": ("a", "b"), "": (None, None), "/": (None, None), ".": (None, None), "x": ("", "x"), "a/../b": ("a/..", "b")}


def test_walk_is_preorder(spark, dirents):
    got = [r["path"] for r in tree.walk(dirents, "root").orderBy("slots").collect()]
    assert got == ["a", "a/b", "a/b/file.txt", "a/b/file.txt", "a/..", "x"]
    loop = spark.createDataFrame([("root", 0, "a", "a", "d"), ("a", 0, "a", "a", "d")], ENTRY)
    with pytest.raises(RecursionError):
        tree.walk(loop, "root")


def test_outcomes_deletes_and_listings(spark, dirents):
    paths = ["a/b", "x/y", "a/none/z", "x", None, "", "a/b/file.txt/q/r"]
    got = {r["path"]: (r["inode_id"], r["kind"], r["outcome"]) for r in tree.outcomes(spark.createDataFrame([(p,) for p in paths], "path string"), dirents, "root").collect()}
    assert got == {"a/b": ("b", "d", "ok"), "x/y": (None, None, "not a directory"), "a/none/z": (None, None, "not found"), "x": ("x", "f", "ok"), None: (None, None, "not found"), "": ("root", "d", "ok"), "a/b/file.txt/q/r": (None, None, "not a directory")}
    asked = spark.createDataFrame([("root", "a"), ("root", "x"), ("root", "x"), ("a", "none")], "parent_id string, name string")
    assert sorted((r["name"], r["outcome"]) for r in tree.delete(dirents, asked).collect()) == [("a", "not empty"), ("none", "not found"), ("x", "deleted")]
    inodes = spark.createDataFrame([("a", 4096, 0, 0), ("b", 4096, 0, 60), ("x", 9, 5, 86400), ("f", 7, 0, 1)], "inode_id string, size long, compressed_size long, modified_at long")
    rows = tree.listing(dirents, inodes, spark.createDataFrame([("/",), ("x",), ("/a/",)], "path string"), "root").collect()
    assert sorted(map(tuple, rows)) == [("", "a", "d", 4096, None, "1970-01-01 00:00:00"), ("", "x", "f", 9, 5, "1970-01-02 00:00:00"), ("a", "a/b", "d", 4096, None, "1970-01-01 00:01:00"), ("x", "x", "f", 9, 5, "1970-01-02 00:00:00")]
    rows = tree.listing(dirents, inodes, spark.createDataFrame([("a",)], "path string"), "root", recursive=True).collect()
    assert sorted(r["name"] for r in rows) == ["a/b", "a/b/file.txt"]


def test_resolve_takes_the_first_entry_and_null_for_missing(spark, dirents):
    paths = ["a/b/file.txt", "/a//./b/", "", "a/none", "a/..", "x/y", None]
    got = dict(tree.resolve(spark.createDataFrame([(p,) for p in paths], "path string"), dirents, "root").collect())
    assert got == {"a/b/file.txt": "f", "/a//./b/": "b", "": "root", "a/none": None, "a/..": "dots", "x/y": None, None: None}


def test_create_rejects_taken_long_and_slashed_names(spark, dirents):
    new = spark.createDataFrame([("a", "b", "n1", "f"), ("a", "new", "n3", "f"), ("a", "new", "n2", "f"), ("a", "q/r", "n4", "f"), ("a", "z" * 256, "n5", "f"), ("a", "z" * 255, "n6", "f"), ("c", "first", "n7", "f")], "parent_id string, name string, inode_id string, kind string")
    got = sorted((r["parent_id"], r["slot"], r["inode_id"]) for r in tree.create_entries(dirents, new).collect())
    assert got == [("a", 2, "n2"), ("a", 3, "n6"), ("c", 0, "n7")]


def test_capacity_counts_bytes(spark):
    names = [("d", k, "é" * 100) for k in range(20)] + [("e", 0, "x")]
    got = {r["parent_id"]: (r["entries"], r["fitting"], r["bytes_used"]) for r in tree.capacity(spark.createDataFrame(names, "parent_id string, slot long, name string")).collect()}
    assert got == {"d": (20, 18, 18 * 218), "e": (1, 1, 19)}
