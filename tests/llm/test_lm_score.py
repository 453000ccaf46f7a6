import math
from collections import Counter

import numpy as np
import pytest

from inodelake.llm import lm_score as lm
from inodelake.llm.queries import QUERIES
from inodelake.runtime import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = table(spark, SF, "documents")
    counts = written(lm.token_counts(docs), "counts")
    vocab = spark.sparkContext.broadcast(lm.vocabulary(counts))
    units = len(vocab.value.classes)
    beside = lm.gathered(lm.counted(lm.coded(docs, vocab), vocab), units)
    nets, n_units = lm.first_networks(beside, units)
    return docs, counts, vocab.value, (beside, n_units), lm.train(beside, nets)


def units_of(v, found):
    return [v.codes.get(t, len(v.codes) + lm.ending(t)) for t in found]


def around(v, units, i, k):
    return v.classes[units[i + k]] if 0 <= i + k < len(units) else lm.EDGE


def probabilities(nets, near):
    """Of all units, between the classes ``near`` (left and right of each network)."""
    total = 0
    for net, (a, b), weight in zip(nets, near, (lm.INNER, 1 - lm.INNER), strict=True):
        z = (net.left[a].astype(float) + net.right[b]) @ net.out.T + net.bias
        total = total + weight * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return total


def test_counts_cover_every_token(fitted):
    docs, counts, *_ = fitted
    want = Counter(t for r in docs.select("text").collect() for t in lm.tokens(r["text"]))
    assert {r["token"]: r["n"] for r in counts.collect()} == want


def test_every_position_is_trained_on(fitted):
    docs, counts, v, beside, _ = fitted
    want = [Counter() for _ in lm.PAIRS]
    units = Counter()
    for r in docs.select("text").collect():
        own = units_of(v, lm.tokens(r["text"]))
        units.update(own)
        for pair, seen in zip(lm.PAIRS, want, strict=True):
            seen.update((int(around(v, own, i, pair[0])), u, int(around(v, own, i, pair[1]))) for i, u in enumerate(own))
    sums = [[np.zeros((lm.CLASSES, n)) for n in (len(v.classes), len(v.classes), lm.CLASSES)] for _ in lm.PAIRS]
    for r in beside[0].collect():
        for k, x in enumerate(("left", "right", "pairs")):
            sums[r["net"]][k][r["class"]] += np.frombuffer(r[x], dtype=np.float32)
    for held, seen in zip(sums, want, strict=True):
        left, right, pairs = (np.zeros(x.shape) for x in held)
        for (a, u, b), n in seen.items():
            left[a, u] += n
            right[b, u] += n
            pairs[a, b] += n
        assert (left == held[0]).all() and (right == held[1]).all() and (pairs == held[2]).all()
    assert sum(units.values()) == sum(r["n"] for r in counts.collect()) == sums[0][2].sum() == beside[1].sum()


def test_steps_raise_the_likelihood(fitted):
    history = fitted[4][2]
    assert len(history) == lm.STEPS + 1 and history[-1] > history[0] + 0.1


def test_gradient_equals_differences(fitted):
    beside, (nets, _, _) = fitted[3][0], fitted[4]
    nets = [lm.Network(*(x.astype(float) for x in n)) for n in nets]
    _, _, total, (grad, _) = lm.gradients(beside, nets)
    fit = lambda n: lm.gradients(beside, [n, nets[1]])[1]
    for k, at in ((0, (4, 1)), (1, (7, 2)), (2, (11, 0)), (3, (5,))):
        up, down = ([x.copy() for x in nets[0]] for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert grad[k][at] == pytest.approx((fit(lm.Network(*up)) - fit(lm.Network(*down))) / 2e-3, rel=1e-2, abs=1e-5 * total)


def test_the_query_equals_brute_force(spark, fitted):
    """Every document of the registered query against softmaxes over all tokens, computed position by position."""
    docs, counts, v, beside, (nets, _, _) = fitted
    n = {r["token"]: r["n"] for r in counts.collect()}
    mass = beside[1]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = QUERIES["op2_lm_score"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    cache = {}
    for r in got:
        found = lm.tokens(texts[r["doc_id"]])
        own, times = units_of(v, found), Counter(found)
        total, unseen = 0.0, 0
        for i, (t, u) in enumerate(zip(found, own, strict=True)):
            near = tuple((int(around(v, own, i, a)), int(around(v, own, i, b))) for a, b in lm.PAIRS)
            if near not in cache:
                cache[near] = probabilities(nets, near)
            total += math.log(cache[near][u])
            if u >= len(v.codes):
                total += math.log(max(n[t] - times[t], 0.5)) - math.log(mass[u] + 1)
                unseen += n[t] == times[t]
        assert r["n_tokens"] == len(found) and r["n_unseen"] == unseen
        assert r["log_prob"] == pytest.approx(total, rel=1e-4)
        assert r["perplexity"] == pytest.approx(math.exp(-total / len(found)), rel=1e-3)


def test_tokens_of_one_class_have_different_context_odds(fitted):
    _, _, v, _, (nets, _, _) = fitted
    places = len(v.codes)
    by_class = {}
    for u in range(lm.OWN, places):
        by_class.setdefault(int(v.classes[u]), []).append(u)
    a, b = next(us for us in by_class.values() if len(us) > 1)[:2]
    odds = [p[a] / p[b] for p in (probabilities(nets, ((x, y), (x, y))) for x, y in ((0, 1), (1, 0), (2, 3), (5, lm.EDGE)))]
    assert max(odds) > 1.05 * min(odds)


def test_both_sides_count(fitted):
    nets = fitted[4][0]
    base = probabilities(nets, ((0, 1), (2, 3)))
    for near in (((4, 1), (2, 3)), ((0, 4), (2, 3)), ((0, 1), (5, 3)), ((0, 1), (2, 6))):
        assert np.abs(probabilities(nets, near) - base).max() > 1e-4


def test_documents_that_occur_twice_score_apart(docs_of):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(4))
    texts = [" ".join(f"the {word(97 * k + 13 * i)} of" for i in range(30)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[k]) for k in range(5)]
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(docs_of(rows)).collect()}
    twice = [got[k] for k in (*range(5), *range(100, 105))]
    once = [got[k] for k in range(5, 40)]
    assert all(r["n_unseen"] == 0 for r in twice) and all(r["n_unseen"] > 0 for r in once)
    assert min(r["mean_log_prob"] for r in twice) > max(r["mean_log_prob"] for r in once)


def test_scrambled_text_scores_lower(fitted, spark, docs_of):
    docs, counts, _, beside, (nets, logs, _) = fitted
    vocab = spark.sparkContext.broadcast(fitted[2])
    real = [r["text"] for r in docs.where("lang = 'en'").limit(20).collect()]
    junk = ["".join(reversed(t)) for t in real]
    rows = lm.coded(docs_of(list(enumerate(real + junk))), vocab)
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(rows, counts, vocab, nets, logs, beside[1]).collect()}
    assert np.mean([got[k] > got[k + len(real)] for k in range(len(real))]) > 0.9


def test_odd_rows(odd_docs, no_docs):
    rows = lm.pseudo_likelihood(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert r["n_tokens"] == 0 and r["log_prob"] == 0 and r["mean_log_prob"] is None and r["perplexity"] is None and r["n_unseen"] == 0
    same = [r["log_prob"] for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert all(math.isfinite(r["log_prob"]) for r in rows)
    assert lm.pseudo_likelihood(no_docs).count() == 0


def test_marks_are_tokens_of_their_own():
    assert lm.tokens("Word! (word a-b; x_1.") == ["word", "!", "(", "word", "a", "-", "b", ";", "x_1", "."]
    assert lm.tokens("\u4e00\u4e8c\uff0c\u4e09\u3002\u56db") == ["\u4e00\u4e8c", "\uff0c", "\u4e09", "\u3002", "\u56db"]
    assert lm.tokens(None) == lm.tokens(" \n") == []


def test_the_most_frequent_tokens_have_places(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "PLACES", 50)
    rows = [(k, " ".join(f"w{i}" for i in range(k, 100))) for k in range(100)]
    counts = written(lm.token_counts(docs_of(rows)), "counts")
    assert list(lm.vocabulary(counts).codes) == [f"w{i}" for i in range(99, 49, -1)]
