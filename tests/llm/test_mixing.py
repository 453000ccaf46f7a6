import re
from collections import defaultdict

import pytest

from inodelake.llm import mixing
from inodelake.llm.queries import ORACLES, QUERIES


def test_equals_sql(same):
    same(QUERIES["op10_mixing"], ORACLES["op10_mixing"])


def plain_targets(sizes):
    """Shares by weight, the excess above the limits reshared until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        if not over:
            break
        open_ -= over
    return target


def test_targets_and_words_taken(docs_of):
    rows, k = [], 0
    for source, n, words in (("a", 300, 3), ("b", 40, 50), (None, 100, 7), ("￿", 5, 2), ("\U0001f600", 60, 20)):
        for i in range(n):
            rows.append((k, "w " * (words + i % 5), "en", source))
            k += 1
    got = mixing.plan_mix(docs_of(rows)).collect()
    size, taken, longest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1])) and r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    want = plain_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2 * longest[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan_mix(docs_of(rows)).collect()), key=str)


def test_mix_repeats_whole_rows(odd_docs, no_docs):
    plan = mixing.plan_mix(odd_docs, keep=("doc_id", "text")).collect()
    assert len(plan) == odd_docs.count()
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(no_docs).count() == 0 and mixing.plan_mix(no_docs).count() == 0


def test_mix_does_not_depend_on_the_order_of_rows(spark, docs_of):
    rows = [(k, " ".join(f"w{k * 7 + i}" for i in range(1 + k % 6)), "en", f"s{k % 3}") for k in range(300)]
    first = docs_of(rows)
    shuffled = docs_of([rows[(k * 97 + 11) % 300] for k in range(300)]).repartition(5)
    taken = lambda d: sorted(r["doc_id"] for r in mixing.mix(d).collect())
    assert taken(first) == taken(shuffled)


def test_own_names_may_be_taken(spark):
    docs = spark.createDataFrame([(7, "a b", "s", 5, {"x": 1}, 9), (8, "a b", "s", 6, None, 9)], "`__row` long, text string, source string, `__CONTENT` int, `__copy` map<string,int>, `a.b` int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {(r["__row"], r["__CONTENT"], r["a.b"]) for r in out.collect()} <= {(7, 5, 9), (8, 6, 9)}
    with pytest.raises(ValueError, match="size"):
        mixing.plan_mix(docs.withColumn("size", docs["__row"]), keep=("size",))
