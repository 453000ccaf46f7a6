import numpy as np
import pytest

from inodelake.llm import ann
from inodelake.llm import vector_dedup as vd
from inodelake.llm.queries import ORACLES, QUERIES
from inodelake.runtime import table

VECTORS = "vec_id long, embedding array<float>, label int, key string, n int, id int, vec string, unit string"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "k", 2, 3, "v", "u") for k, v in rows], VECTORS)


def clustered(n=600, groups=((60, 0.02), (5, 0.02), (2, 0.02), (2, 0.0)), seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32))
    at = 0
    for size, noise in groups:
        x[at : at + size] = x[at] + noise * np.linalg.norm(x[at]) * rng.standard_normal((size, 32))
        at += size
    order = rng.permutation(n)
    return [(int(k), x[i].astype(np.float32).tolist()) for k, i in enumerate(order)]


def unit(rows):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("name", ["op4_vector_near_dedup", "op5_nearest_neighbours"])
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_scores_are_those_of_plain_sums(duck):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64)).astype(np.float32).astype(float)
    duck.execute("CREATE OR REPLACE TABLE pairs (a DOUBLE[], b DOUBLE[])")
    duck.executemany("INSERT INTO pairs VALUES (?, ?)", [(v.tolist(), x[0].tolist()) for v in x])
    want = [r[0] for r in duck.execute("SELECT list_cosine_similarity(a, b) FROM pairs").fetchall()]
    assert ann.cosines(x, x[0]).tolist() == want
    assert ann.cosines(x * 1e-200, x[0] * 1e200) == pytest.approx(want)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 16)
    rows = clustered()
    close = unit(rows) @ unit(rows).T >= 0.95
    np.fill_diagonal(close, False)
    from inodelake.llm.ngram_join import roots_of

    root = roots_of(close)
    got = {r["vec_id"]: r for r in vd.near_vectors(frame(spark, rows)).collect()}
    assert [got[k]["n_links"] for k in range(len(rows))] == close.sum(1).tolist()
    assert [got[k]["component_id"] for k in range(len(rows))] == root.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["recall"] >= vd.RECALL for r in got.values())


def test_cores_and_the_rest_of_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 8)
    rows = clustered(300, ((50, 0.008), (40, 0.03), (30, 0.05)), seed=7)
    close = unit(rows) @ unit(rows).T >= 0.95
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in vd.near_vectors(frame(spark, rows)).collect()}
    assert close.sum() > 4000 and [got[k] for k in range(len(rows))] == close.sum(1).tolist()


ODD = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [NAN, 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, -1.0]), (None, [1.0, 0.01])]


def test_odd_vectors(spark):
    rows = vd.near_vectors(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)
    want = [(1, 3, 1)] * 2 + [(2, 3, 1), (None, 3, 1)] + [(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted(want, key=str)
    assert vd.near_vectors(frame(spark, ODD).where("false")).count() == 0


def test_neighbours_on_the_real_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    x, ids = unit(rows), np.array([k for k, _ in rows])
    found = ann.op5_nearest_neighbours(spark, sf).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == sorted(k for k in ids.tolist() if k % 50 == 0)
    hits = 0
    for q, near in by.items():
        cos = x @ x[ids == q][0]
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == [1, 2, 3, 4, 5] and all(r["vec_id"] != q for r in near)
        assert all(r["score"] == pytest.approx(cos[ids == r["vec_id"]][0], abs=1e-12) for r in near)
        assert [(-r["score"], r["vec_id"]) for r in near] == sorted((-r["score"], r["vec_id"]) for r in near)
        cos[ids == q] = -2
        hits += len({r["vec_id"] for r in near} & set(ids[np.lexsort((ids, -cos))[:5]].tolist()))
    assert hits / (5 * len(by)) >= 0.9


def test_lists_are_split_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "RERANK", 16)
    rows = clustered(1500, ((500, 0.1),))
    x = unit(rows)
    df = frame(spark, rows)
    found = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    hits = 0
    for r in found:
        cos = x @ x[r["query_id"]]
        cos[r["query_id"]] = -2
        hits += cos[r["vec_id"]] >= np.sort(cos)[-5] - 1e-12
        assert r["score"] == pytest.approx(cos[r["vec_id"]], abs=1e-12)
    assert len(found) == 5 * 30 and hits / len(found) >= 0.9


def test_ties_few_candidates_and_odd_vectors(spark):
    df = frame(spark, [*ODD, (50, [3.0, 0.0])])
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, df.where("vec_id in (50, 3, 9)"), 5).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 10, 0.0)]
    assert ann.nearest(df.where("false"), df).count() == 0 and ann.nearest(df, df.where("false")).count() == 0


def test_copies_beyond_the_rerank_keep_the_tie_rule(spark):
    x = np.random.default_rng(3).standard_normal((400, 32)).astype(np.float32)
    rows = [(k, (x[0] if k % 2 else x[k % 400]).tolist()) for k in range(800)]
    df = frame(spark, rows)
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (1, 3, 401, 799)")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, near in got.items():
        # 0 and 400 are copies of the same vector as the odd ids
        assert sorted(near) == list(enumerate([i for i in (0, 1, 3, 5, 7, 9) if i != q][:5], 1))
    assert len(got) == 4


def test_scaled_copies_beyond_the_rerank_are_all_compared(spark):
    x = np.random.default_rng(4).standard_normal((400, 32)).astype(np.float32)
    rows = [(k, (x[0] * np.float32(2.0 ** (k % 60 - 30)) if k % 2 else x[k % 400]).tolist()) for k in range(800)]
    df = frame(spark, rows)
    found = ann.nearest(df, df.where("vec_id in (1, 799)")).collect()
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 799) == [0, 1, 3, 5, 7]
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 1) == [0, 3, 5, 7, 9]
    assert {r["recall"] for r in found} == {1.0}


@pytest.mark.parametrize("recall", (0.999, 1.1))
def test_links_between_dense_groups_are_found(spark, monkeypatch, recall):
    # no audited vector is in a group; with a recall out of reach all vectors are compared at the end
    monkeypatch.setattr(vd, "AUDIT", 1)
    monkeypatch.setattr(vd, "RECALL", recall)
    monkeypatch.setattr(vd, "ROUNDS", 1)
    monkeypatch.setattr(vd, "CENTERS", 64)
    rng = np.random.default_rng(5)
    a, b, *rest = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    groups = [c + 0.003 * rng.standard_normal((40, 32)) for c in (a, 0.96 * a + 0.28 * b)]
    x = np.concatenate([*groups, rng.standard_normal((400, 32))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    close = unit(rows) @ unit(rows).T >= 0.95
    np.fill_diagonal(close, False)
    assert close[:40, 40:80].sum() > 1000
    got = {r["vec_id"]: r for r in vd.near_vectors(frame(spark, rows)).collect()}
    assert [got[k]["n_links"] for k in range(len(rows))] == close.sum(1).tolist()
    assert {got[k]["component_id"] for k in range(80)} == {0}


def test_each_length_is_searched(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0])])
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vd.near_vectors(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id in (3, 4)")).orderBy("query_id", "rank").collect()] == [(3, 1), (3, 2), (4, 5)]


@pytest.mark.parametrize("kind", ("alike", "unlike", "poor search"))
def test_no_nearest_vector_is_missed(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 32))
    if kind == "unlike":  # queries that lie far from all other vectors
        x[::50] -= 6
    if kind == "poor search":  # a search that finds next to nothing, queries checked in several turns
        monkeypatch.setattr(ann, "COVER", 0.0)
        monkeypatch.setattr(ann, "RECALL", 0.0)
        monkeypatch.setattr(ann, "CHECKED", 16 * 32 * 8)
        monkeypatch.setattr(ann, "CHECK_ROWS", 100)
        monkeypatch.setattr(ann, "CHECK_QUERIES", 3)
        x[:1000] = x[0] + 0.2 * x[:1000]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    df, u = frame(spark, rows), unit(rows)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert r["recall"] == 1.0
    assert sorted(got) == list(range(0, 2000, 50))
    for q, near in got.items():
        cos = u @ u[q]
        cos[q] = -2
        assert [near[n] for n in range(1, 6)] == np.argsort(-cos, kind="stable")[:5].tolist()
