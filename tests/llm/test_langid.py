import zlib

import numpy as np
import pytest

from inodelake.llm import langid
from inodelake.runtime import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(table(spark, SF, "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_marks_equal_a_plain_set():
    def place(gram):
        code = len(gram)
        for b in gram:
            code = ((code << 8) & 0xFFFFFFFF) ^ (code >> 24) ^ b
        return (code * 2654435761 & 0xFFFFFFFF) >> 32 - langid.BITS

    texts = ["Abc äbc", "", "x", "abcabc" * 50]
    got = langid.marks(texts)
    pad = b"\0" * (max(langid.LENGTHS) - 1)
    for text, row in zip(texts, got, strict=True):
        raw = pad + text.lower().encode() + pad
        want = {place(raw[i - n + 1 : i + 1]) for n in langid.LENGTHS for i in range(len(pad), len(raw))}
        assert set(np.flatnonzero(row).tolist()) == want


def test_scores_equal_kernels_with_landmarks():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdef" if k % 2 else "defghi"), 30)) for k in range(40)]
    langs = np.array(["x" if k % 2 else "y" for k in range(40)])
    bits = langid.marks(texts).astype(float)
    model = langid.fit(bits.astype(np.uint8), langs, landmarks=10)
    unit = bits / np.sqrt(bits.sum(1, keepdims=True))
    turn = np.array([k // 2 for k in range(40)])
    z = unit[np.lexsort((langs, turn))[:10]]
    values, vectors = np.linalg.eigh(z @ z.T)
    phi = (unit @ z.T) @ (vectors / np.sqrt(values))
    y = np.where(langs[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * 40 * np.eye(10), phi.T @ y)
    assert np.allclose(phi @ w, unit @ model.weights, atol=1e-3)


def test_fitting_unpacks_few_rows_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(0)
    packed = rng.integers(0, 256, (1500, (1 << langid.BITS) // 8), dtype=np.uint8)
    langs = np.repeat(list("abc"), 500)
    tracemalloc.start()
    model = langid.fit(packed, langs, landmarks=12, packed=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20  # the rows unpacked are 49 MB, as numbers 197 MB
    plain = langid.fit(np.unpackbits(packed, axis=1), langs, landmarks=12)
    assert plain.languages == model.languages and np.array_equal(plain.weights, model.weights)


def test_numerals_are_no_letters(model):
    assert langid.predict(["\u00bd \u00b2 \u2460 7", "\u2167 1_2", "\u00bd a"], model)[0][:2] == ["und", "und"]
    assert not langid.has_letter("\u00bd \u00b2 \u2460 _ 7") and langid.has_letter("\u00bd\u00e9") and not langid.has_letter(None)


def test_every_language_is_learned(docs_of):
    words = {f"l{k}": " ".join(chr(0x4E00 + 97 * k + i) * 3 for i in range(20)) for k in range(60)}
    rows = [(k, text, lang) for k, (lang, text) in enumerate([x for x in words.items() for _ in range(12)])]
    rows += [(1000 + k, "the common words of one language " * 3, "en") for k in range(200)] + [(5000, "\u00bd", "zz")]
    docs = docs_of(rows)
    model = langid.train(docs, most=61, landmarks=8)
    assert model.languages == sorted([*words, "en"])
    assert langid.predict(list(words.values()), model)[0] == list(words)


def test_too_many_languages_are_an_error(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(docs_of([(k, "abc", f"l{k}") for k in range(20)]))


def test_the_query_equals_its_operator(spark, model):
    from inodelake.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r) for r in QUERIES["op9_language_id"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    langs, scores = langid.predict(list(texts.values()), model)
    assert got == {k: (k, zlib.crc32(str(k).encode()) % 5 == 0, g, pytest.approx(float(p))) for k, g, p in zip(texts, langs, scores, strict=True)}


def test_odd_rows(odd_docs, no_docs, model):
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["lang_pred"] for k in (2, 3, 4, 6) for r in by[k]} == {"und"} and by[2][0]["score"] == 0
    assert by[1][0] == by[1][1] and by[8][0]["lang_pred"] != "und"
    assert sorted(r["lang_pred"] == "und" for r in by[None]) == [False, True] and all(r["held_out"] for r in by[None])
    assert langid.train(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
