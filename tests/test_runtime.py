from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inodelake import runtime


def test_clean_deletes_own_folders(spark):
    folder = runtime.shared_folder(spark)
    spark.range(3).write.parquet(f"{folder}/t")
    kept = [x for x in runtime._made if x != folder]
    runtime._made[:] = [folder]
    assert runtime.clean() == 1 and not Path(folder.removeprefix("file://")).exists() and runtime.clean() == 0
    runtime._made[:] = kept


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_folder(Spark())
    Spark.sparkContext.master = "local[4]"
    assert runtime.shared_folder(Spark()).startswith("file://")


def test_free_names():
    assert runtime.free_name("__row", "a", "__ROW", "__row_") == "__row__"


def test_running_sums_beside_clashing_names(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("__tie"), F.col("id").alias("__part"), F.lit(1).alias("__total"))
    got = runtime.with_running(rows, ["k"], [F.col("__tie")], F.col("__tie"), "upto").collect()
    assert all(r["upto"] == sum(x for x in range(r["__tie"] + 1) if x % 3 == r["k"]) and r["__part"] == r["__tie"] for r in got) and len(got) == 50
