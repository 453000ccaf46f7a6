import ast
import re
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from inodelake.llm import langid, mixing, ngram_join, packing
from inodelake.runtime import table, written
from tests.llm.test_mixing import plain_targets
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check as check_packing

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "near_copies", "mixing", "packing"]
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == table(spark, SF, "documents").columns
        kept.append(docs)
    every = table(spark, SF, "documents")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(every, langid.train(every)).collect()}
    stays = {r["doc_id"] for r in every.collect() if found[r["doc_id"]][0] != "und" and (found[r["doc_id"]][0] == r["lang"] or found[r["doc_id"]][1] < p.CONFIDENT)}
    assert {r["doc_id"] for r in kept[0].collect()} == stays
    assert kept[1].count() == ngram_join.jaccard_classes(kept[0]).where("kept").count()
    assert kept[2].count() == sum(r["copies"] for r in mixing.plan_mix(kept[1]).collect())
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.where("piece = 0").count() == docs.count() and last.count() == packing.pack(docs).count()
    assert last.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_run_equals_brute_force(spark):
    """Language by one text at a time, all pairs of texts, targets by resharing, and ids by the library."""
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    model = langid.train(docs)
    left = []
    for d in docs.collect():
        (lang,), (score,) = langid.predict([d["text"]], model)
        if lang != "und" and (d["lang"] == lang or d["lang"] not in model.languages or score < p.CONFIDENT):
            left.append(d)
    class_of = {k: c for k, c, _ in brute([(d["doc_id"], d["text"]) for d in left])}
    rows = p.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert set(copies) <= set(class_of) and max(copies.values()) <= 2
    assert len({class_of[k] for k in copies}) == len(copies)
    # one of each class was mixed; the sizes of those left out are known only up to the class's spread
    by_id = {d["doc_id"]: d for d in left}
    n_words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", by_id[k]["text"]))
    one = {c: min(k for k in class_of if class_of[k] == c) for c in set(class_of.values())}
    size, taken, longest = Counter(), Counter(), Counter()
    for k in {**one, **{class_of[k]: k for k in copies}}.values():
        size[by_id[k]["source"]] += n_words(k)
        longest[by_id[k]["source"]] = max(longest[by_id[k]["source"]], n_words(k))
    for k, n in copies.items():
        taken[by_id[k]["source"]] += n * n_words(k)
    target = plain_targets(size)
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] + 0.1 * size[s] for s in size)
    check_packing(rows, [by_id[k] for k, n in copies.items() for _ in range(n)], 2048)


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    import corpus_pipeline as p

    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    docs, seen = unlabelled, []
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert seen[0] == [1, 1, 5, 7, 8, None] and seen[1] == [1, 5, 7, 8, None]
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(unlabelled.where("doc_id is null and text is not null or doc_id in (5, 7, 8)").union(unlabelled.where("doc_id = 1").limit(1))).collect()}
    assert set(seen[2]) <= set(seen[1]) and len(seen[2]) == sum(plan.values())
    pieces = docs.collect()
    assert len({(r["doc_id"], r["piece"]) for r in pieces}) == len({(k, n) for k in set(seen[2]) for n in range(sum(r["doc_id"] == k for r in pieces) // seen[2].count(k))})
    assert sorted((r["doc_id"] for r in pieces if r["piece"] == 0), key=str) == seen[2]
    docs = no_docs
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_wrong_labels_go(spark, docs_of):
    import corpus_pipeline as p

    texts = {"en": "the quick brown fox jumps over the lazy dog and then they went to the other house", "de": "der schnelle braune fuchs springt und dann ging er nicht in das andere haus zur\u00fcck"}
    rows = [(k, f"{texts[lang]} {k}", lang) for k, lang in enumerate(["en", "de"] * 60)]
    held = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 5 == 0)
    rows += [(500, texts["en"], "de"), (501, texts["en"], None), (held, texts["de"], "zz"), (502, "123 456", "en")]
    kept = {r["doc_id"] for r in p.language_stage(spark, docs_of(rows), SF).collect()}
    assert kept == {k for k, _, _ in rows} - {500, 502}


def test_clean_texts_stay_without_a_model(spark, docs_of):
    import corpus_pipeline as p

    texts = ["one two three four", "drei vier", "\u00e9", None, "", " 12 !? ", "one two three four"]
    for rows in ([(k, t, None) for k, t in enumerate(texts)], [(None, t, "en") for t in texts]):
        kept = p.language_stage(spark, docs_of(rows), SF)
        assert sorted(r["text"] for r in kept.collect()) == ["drei vier", "one two three four", "one two three four", "\u00e9"]


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for f in (root / "inodelake").rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("inodelake.llm") for n in names), f
