import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inodelake.llm import packing
from inodelake.runtime import table


def filled(slots):
    """Every bin's pieces as (offset, length), by bin."""
    bins = defaultdict(list)
    for length, first, after, each, base, offset in slots:
        for rank in range(first, after):
            bins[base + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    return bins


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 30), max_size=12))))
def test_plan_is_whole_and_tight(case):
    capacity, counts = case
    slots, n = packing.plan_bins(counts, capacity)
    bins = filled(slots)
    assert sorted(bins) == list(range(n))
    seen = defaultdict(int)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
            seen[length] += 1
        assert at <= capacity and sum(3 * length > capacity for _, length in pieces) <= 2
    assert dict(seen) == {k: v for k, v in counts.items() if v}
    need = math.ceil(sum(k * v for k, v in counts.items()) / capacity)
    big = sum(v for k, v in counts.items() if 2 * k > capacity)
    assert n <= 1.5 * max(need, big) + 1


def test_slots_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(0)
    sizes = [len(packing.plan_bins(dict(zip(*(x.tolist() for x in np.unique(np.minimum(rng.lognormal(5.5, 1.2, n).astype(int) + 1, 2048), return_counts=True)), strict=True)), 2048)[0]) for n in (10**5, 10**6, 10**7)]
    assert max(sizes) < 8 * 2048


def check(rows, docs, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bins = defaultdict(list)
    got = defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(int)
    for d in docs:
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            want[d["doc_id"], k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())] += 1
    assert got == want
    return len(bins)


def test_corpus_is_packed_nearly_full(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packing.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, docs.collect(), 2048)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1


def test_odd_rows(odd_docs, no_docs):
    check(packing.pack(odd_docs, 16).collect(), odd_docs.collect(), 16)
    assert packing.pack(no_docs).count() == 0
