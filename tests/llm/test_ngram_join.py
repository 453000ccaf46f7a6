import random
from collections import defaultdict

import numpy as np
import pytest

from inodelake.llm import ngram_join as nj
from inodelake.llm.queries import ORACLES, QUERIES


def brute(rows, threshold=0.8):
    """class_id and n_links by comparing all pairs; sets of tuples of words, not of hashes."""
    sets = []
    for _, text in rows:
        w = nj.WORD.findall((text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, links[i]) for i in members]
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    new = lambda n: [rng.choice(words) for _ in range(n)]
    common = new(60)
    rows = []
    for n in (2, 3, 40):  # groups of near copies
        base = new(200)
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(common + new(rng.choice([20, 60, 300]))) for _ in range(60)]  # a shared passage
    rows += [" ".join(new(rng.choice([1, 3, 5, 30, 400]))) for _ in range(60)]
    rows += ["", None, "...", "same short", "Same, short!"] + ["copy of a text that is long enough to count"] * 7
    return [(k, t) for k, t in enumerate(rows)]


def test_equals_sql(same):
    same(QUERIES["op6_ngram_jaccard"], ORACLES["op6_ngram_jaccard"])


def test_equals_brute_force(docs_of):
    rows = corpus()
    got = nj.jaccard_classes(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_large_nodes_are_split_and_blocks_compared(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BUCKET", 8)
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = corpus(2)
    got = nj.jaccard_classes(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_compare_is_exact_at_the_threshold():
    a = np.arange(10, dtype=np.uint64)
    sets = [a[:10], a[:8], a[:7], np.arange(100, 110, dtype=np.uint64), a[:4]]
    got = nj._compare(sets, sets, 0.8)
    want = [[len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y)) for y in sets] for x in sets]
    assert (got == np.array(want)).all()


def test_odd_rows(odd_docs, no_docs):
    rows = nj.jaccard_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [(r["class_id"], r["n_links"]) for r in by[1]] == [(1, 1)] * 2
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for k in (2, 3, 4, 5, 6, 7, 8) for r in by[k])
    assert nj.jaccard_classes(no_docs).count() == 0


def test_one_document_of_each_group_stays(odd_docs, docs_of, no_docs):
    left = nj.near_unique(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1
    rows = corpus(3)
    kept = {r["doc_id"] for r in nj.near_unique(docs_of(rows)).collect()}
    classes = defaultdict(set)
    for k, c, _ in brute(rows):
        classes[c].add(k)
    assert all(len(kept & members) == 1 for members in classes.values())
    assert nj.near_unique(no_docs).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b c d", "a b c d e", "a b c d e f " * 1000])
def test_shingles_of_a_text(text):
    w = (text or "").split()
    assert len(nj.shingles(text)) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())


def test_the_audit_repeats_the_runs(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "FOUND", 1.1)
    monkeypatch.setattr(nj, "REPEATS", 2)
    turns, real = [], nj.candidate_edges
    monkeypatch.setattr(nj, "candidate_edges", lambda *a: turns.append(a[-1]) or real(*a))
    with pytest.raises(RuntimeError, match="audited pairs"):
        nj.jaccard_classes(docs_of(corpus(4)))
    assert turns == [0, 1]


def test_repeated_and_missing_ids(docs_of):
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text), (7, text), (None, text), (None, text), (3, text + " x y z a b c d e"), (7, "another text of some words that stands alone")]
    got = nj.jaccard_classes(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["kept"]) for r in got) == sorted(
        [("7", "7", 3, True), ("7", "7", 3, False), ("None", "7", 3, False), ("None", "7", 3, False), ("3", "3", 0, True), ("7", "7", 0, True)]
    )


def test_many_candidates_are_merged_and_bands_compared(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST", 3)
    monkeypatch.setattr(nj, "BLOCK", 4)
    monkeypatch.setattr(nj, "BUCKET", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(k, " ".join(base[: 100 + 7 * k])) for k in range(40)]
    got = nj.jaccard_classes(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_cores_and_the_rest_of_large_clusters(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for edits in (3, 8, 25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(300)] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = nj.jaccard_classes(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_own_names_may_be_taken(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 2)], "`__row` long, text string, `__OWN` string, set_id int")
    left = nj.near_unique(docs)
    assert left.columns == docs.columns and [(r["__row"], r["__OWN"]) for r in left.collect()] == [(5, "x")]
    with pytest.raises(ValueError, match="sketch"):
        nj.jaccard_classes(docs.withColumn("sketch", docs["set_id"]), keep=("sketch",))


def test_long_texts_come_a_few_at_a_time(spark, docs_of):
    from inodelake.llm.tokens import small_batches

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    docs = docs_of([(k, f"{k} " + "word " * 20_000) for k in range(200)]).repartition(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    assert small_batches(docs).select("text").mapInArrow(sizes, "size long").agg({"size": "max"}).first()[0] <= 5 << 20
