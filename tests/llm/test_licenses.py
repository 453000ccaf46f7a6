import re

from inodelake.llm import licenses
from inodelake.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_equals_sql(same):
    same(QUERIES["op1_license_scan"], ORACLES["op1_license_scan"])


def spans_of(df):
    return {r["doc_id"]: [(s["label"], s["start"], s["words"]) for s in r["spans"]] for r in df.collect()}


def test_base_places_are_exact(docs_of):
    texts = ["CC-BY and cc by, cc", "all rights reserved all rights reserved", "General Public\nLicense", "all rights are reserved", "cc by", "generalpublic license"]
    got = spans_of(licenses.license_spans(docs_of(list(enumerate(texts))), licenses.BASE))
    for k, text in enumerate(texts):
        w = words(text)
        want = [(t.label, i, len(p)) for t in licenses.BASE for p in [t.text.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        assert got[k] == sorted(want, key=lambda x: x[1])


def test_notices_with_edits_are_found_and_prose_is_not(docs_of):
    mit = next(t for t in licenses.NOTICES if t.label == "mit")
    w = mit.text.split()
    edited = " ".join(w[:10] + ["really"] + w[10:20] + w[21:])
    got = spans_of(licenses.license_spans(docs_of([(1, f"before it {mit.text} after"), (2, edited), (3, " ".join(w[:6])), (4, " ".join(reversed(w)))])))
    assert ("mit", 2, len(w)) in got[1]
    assert [s[0] for s in got[2]] == ["mit"]
    assert got[3] == [] and got[4] == []


def test_every_notice_is_found_by_its_label(docs_of):
    rows = [(k, f"some words, {t.text.upper()}; and more") for k, t in enumerate(licenses.NOTICES)]
    got = spans_of(licenses.license_spans(docs_of(rows)))
    for k, t in enumerate(licenses.NOTICES):
        assert (t.label, 2, len(t.text.split())) in got[k]
    assert len({t.label for t in licenses.NOTICES}) >= 17


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.license_spans(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and all(any(s["label"] == "reserved" for s in r["spans"]) for r in by[1])
    assert sorted(r["n_words"] for r in by[None]) == [0, 10]
    assert sum(s["label"] == "apache-2.0" for s in by[5][0]["spans"]) == 4000
    assert licenses.license_spans(no_docs).count() == 0
