import json
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inodelake.llm import idfiles
from inodelake.llm.tokens import WordTokenizer
from inodelake.runtime import shared_folder, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return WordTokenizer(PATH, memory=500)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,!aAé0́ \x1cİΣß²<|>")), max_size=40))
def test_chunks_give_the_librarys_ids(codec, plain, text):
    assert codec.encode([text])[0].tolist() == plain(text)


def test_real_texts_give_the_librarys_ids(spark, codec, plain):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    assert all(a.tolist() == plain(t) for a, t in zip(codec.encode(texts), texts, strict=True))


def test_letters_that_normalization_takes_apart(codec, plain):
    changed = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalpha() and unicodedata.normalize("NFC", c) != c]
    assert len(changed) > 500
    texts = [f"{a}{c}{mark} {c}{a} x{mark}" for c in changed for a in ("", "a", "\u05d0") for mark in ("-", "!)", ".", "_")]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == plain(text), ascii(text)


def test_letters_that_lower_case_takes_apart_before_marks(codec, plain):
    letters = [*map(chr, range(0xA0, 0x250)), "İ", "Σ", "ς", "ẞ", "ŉ", "ǰ", "ﬁ", "Å", "K"]
    texts = [f"{a}{c}{b}{mark} {c}{mark}{a}{c.lower()}" for c in letters for a in ("", "A", "ß", "íà") for b in ("", "s") for mark in (",", "-!", "|", ">", "'s", "\x01", " \x01 ")]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == plain(text), ascii(text)


def test_a_word_is_encoded_once_whatever_its_case_and_marks(plain):
    codec = WordTokenizer(PATH)
    texts = ["Größe, größe. GRÖSSE", "word Word, WORD! word?", '"word" (Größe) größe;', "word. Word; word: größe: Größe!"]
    assert [x.tolist() for x in codec.encode(texts)] == [plain(t) for t in texts]
    assert {u for u in codec.young if u.isalpha()} == {"größe", "grösse", "word"}


@pytest.mark.parametrize("memory", [150_000, 600_000])
def test_more_new_words_than_memory_beside_old_ones(plain, memory):
    codec = WordTokenizer(PATH, memory=memory)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(4))
    n = memory // 250
    codec.encode(["common words, that stay"])
    for turn in range(2):
        texts = ["common words, that stay " + " ".join(word(turn * 7919 + k) + "q" * (k % 3) for k in range(t * n, t * n + n)) for t in range(256)]
        got = codec.encode(texts)
        for t in (0, 100, 255):
            assert got[t].tolist() == plain(texts[t])
    assert codec.encode(["common words, that stay"])[0].tolist() == plain("common words, that stay")


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    setup = json.loads(Tokenizer.from_file(PATH).to_str())
    setup["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z]+\\.|."}
    (tmp_path / "other.json").write_text(json.dumps(setup))
    texts = ["One two. three", None, "", "a.b c.", " x"]
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    got = WordTokenizer(str(tmp_path / "other.json")).encode(texts)
    assert [g.tolist() for g in got] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**17), max_size=300))
def test_packing_is_lossless(ids):
    ids = np.array(ids, dtype=np.uint32)
    table_, control, data = idfiles.pack(ids)
    assert (idfiles.unpack(table_, control, data, len(ids)) == ids).all()


def test_many_ranks_take_more_bytes():
    ids = np.arange(70_000, dtype=np.uint32)[::-1].repeat(2)
    table_, control, data = idfiles.pack(ids)
    assert len(data) == 2 * (256 + (65_536 - 256) * 2 + (70_000 - 65_536) * 3)
    assert (idfiles.unpack(table_, control, data, len(ids)) == ids).all()


def test_files_hold_every_document_in_order(spark, odd_docs, plain):
    folder = f"{shared_folder(spark)}/ids"
    manifest = idfiles.write_id_files(odd_docs, folder, tokens=20)
    assert manifest.count() > 2
    got = sorted(idfiles.read_id_files(manifest, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    at = 0
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        if r["doc_id"] is not None:
            assert r["ids"] == [*plain(texts[r["doc_id"]]), 2]
        at += r["n_tokens"]


def test_no_documents(spark, no_docs):
    folder = f"{shared_folder(spark)}/ids"
    assert idfiles.read_id_files(idfiles.write_id_files(no_docs, folder), folder).count() == 0


def test_the_query_equals_brute_force(spark, plain):
    from inodelake.llm.queries import QUERIES

    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_token_ids"](spark, "/root/testdata/sf0.001").collect()}
    want, at = {}, 0
    for r in sorted(table(spark, "/root/testdata/sf0.001", "documents").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain(r["text"]), 2], dtype="<u4")
        want[r["doc_id"]] = at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)
    assert got == want


def test_one_id_for_many_rows(spark, docs_of, plain):
    folder = f"{shared_folder(spark)}/ids"
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, "x y") for k in range(5)]
    got = idfiles.read_id_files(idfiles.write_id_files(docs_of(rows).repartition(4), folder, tokens=100), folder, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3, 4] + [7] * 300
    assert sorted(r["ids"] for r in got) == sorted([*plain(t), 2] for _, t in rows)
