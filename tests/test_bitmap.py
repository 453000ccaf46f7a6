from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inodelake.operators import bitmap

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def bits_of(spark, used):
    return spark.createDataFrame(list(enumerate(used)), "bit_index long, used boolean")


def plain_runs(used):
    runs, start = [], None
    for k, u in enumerate([*used, True]):
        if not u and start is None:
            start = k
        if u and start is not None:
            runs.append((start, k - start))
            start = None
    return runs


@FEW
@given(st.lists(st.booleans(), max_size=40))
def test_runs_cross_stretches(spark, used):
    got = sorted((r["run_start"], r["run_length"]) for r in bitmap.free_runs(bits_of(spark, used), stretch=4).collect())
    assert got == plain_runs(used)


def test_stats_of_empty_full_and_free(spark):
    for used, want in (([], (0, 0, 0, 0, 0, 0.0, 0.0)), ([True] * 3, (3, 3, 0, 0, 0, 0.0, 0.0)), ([False] * 3, (3, 0, 3, 1, 3, 3.0, 0.0)), ([False, True, False], (3, 1, 2, 2, 1, 1.0, 1.0))):
        assert tuple(bitmap.frag_stats(bits_of(spark, used)).first()) == want


def test_first_free_sequence(spark):
    assert [bitmap.first_free(bits_of(spark, u)).first()[0] for u in ([False] * 3, [True, False, False], [True, True, False], [False, True, False], [True])] == [0, 1, 2, 0, None]


def test_allocation_is_first_fit_and_runs_out(spark):
    bits = bits_of(spark, [True, False, True, False, False])
    wanted = spark.createDataFrame([(7, 2), (3, 1), (9, 2), (5, 0)], "request_id long, n_blocks long")
    got = {(r["request_id"], r["nth"]): r["bit_index"] for r in bitmap.allocate_first_fit(bits, wanted).collect()}
    assert got == {(3, 0): 1, (7, 0): 3, (7, 1): 4, (9, 0): None, (9, 1): None}


def test_freeing_ignores_low_numbers_and_repeats(spark):
    freed = spark.createDataFrame([(0,), (2,), (2,), (9,)], "bit_index long")
    got = dict(bitmap.free_bits(bits_of(spark, [True] * 4), freed, 1).collect())
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_layout_leaves_out_empty_files(spark):
    files = spark.createDataFrame([(1, 1), (2, 0), (3, 4097), (4, 4096)], "file_id long, size long")
    assert sorted(tuple(r) for r in bitmap.contiguous_layout(files, 10).collect()) == [(1, 1, 10), (3, 2, 11), (4, 1, 13)]


def test_ranks_of_equal_rows_and_nulls(spark):
    from pyspark.sql import functions as F

    from inodelake.runtime import with_rank

    rows = spark.createDataFrame([(None, 1)] * 5 + [("a", 2)] * 4, "k string, v long")
    got = with_rank(rows, ["k"], [F.col("v")]).collect()
    assert sorted(r["rank"] for r in got if r["k"] is None) == [1, 2, 3, 4, 5]
    assert sorted(r["rank"] for r in got if r["k"] == "a") == [1, 2, 3, 4]
