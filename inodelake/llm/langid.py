"""Language identification with blended-spectrum string kernels and Nystroem ridge regression.

A text is the set of its byte n-grams of several lengths, hashed to BITS places.
The kernel of two texts is the number of n-grams that both have, over the root of
the product of their numbers. A few training texts are landmarks; a text is
mapped to its kernels with them, and one ridge regression per language, against
the rest, is fitted on the mapped training texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from inodelake.llm.tokens import small_batches
from inodelake.runtime import table

LENGTHS = (2, 3, 4)
BITS = 15
#: The most training texts per language and (but for one a language) of all languages together; least number of landmarks, one a language at least.
PER_LANGUAGE, MOST, LANDMARKS = 1000, 6000, 384
#: More languages than this are an error, none is left out.
LANGUAGES = 2000
#: Texts per language beyond those wanted that the hash lets through before they are counted.
SPARE = 20
RIDGE = 1e-3
#: How sharply the regressions' outputs are turned into a score.
SHARP = 6.0
UNKNOWN = "und"
WORDLIKE = re.compile(r"[^\W\d_]")
#: Texts looked at together: at most so many, and so many bytes unless one alone has more.
TEXTS, BYTES = 64, 1 << 20
#: N-gram places whose weights are made at a time.
PLACES = 4096


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # of each n-gram place for each language: landmarks times regressions


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as fractions are none."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text or ""))


def marks(texts: list[str], lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> np.ndarray:
    """A row per text with True at the places of its n-grams, whole texts in lower case."""
    pad = b"\0" * (max(lengths) - 1)
    raw = [t.lower().encode("utf-8", "replace") + pad for t in texts]
    own = np.frombuffer(pad + b"".join(raw), dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(raw), dtype=np.int64) << bits, [len(r) for r in raw])
    out = np.zeros(len(raw) << bits, dtype=bool)
    lead, n = len(pad), len(row)
    for length in lengths:
        code = np.full(n, length, dtype=np.uint32)
        for k in range(length):
            code = (code << np.uint32(8)) ^ (code >> np.uint32(24)) ^ own[lead - length + 1 + k : lead - length + 1 + k + n]
        code *= np.uint32(2654435761)
        code >>= np.uint32(32 - bits)
        out[row + code] = True
    return out.reshape(len(raw), -1)


def _blocks(texts: list[str]) -> Iterator[list[int]]:
    block: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if block and (len(block) >= TEXTS or size + len(t) > BYTES):
            yield block
            block, size = [], 0
        block.append(k)
        size += len(t)
    if block:
        yield block


def fit(bits: np.ndarray, languages: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE, packed: bool = False) -> Model:
    """The model of training texts given as rows of marks (``packed``: eight to a byte), with their languages.

    Landmarks are taken in turn from each language, in the order of the rows; each language has one at least. Only
    the landmarks are held as numbers, of the other rows TEXTS at a time, so packed rows are most of what it takes.
    """
    names = sorted(map(str, set(languages)))
    landmarks = max(landmarks, len(names))
    turn = np.zeros(len(languages), dtype=np.int64)
    for name in names:
        turn[languages == name] = np.arange(np.count_nonzero(languages == name))
    chosen = np.lexsort((languages, turn))[:landmarks]

    def units(some: np.ndarray) -> Iterator[np.ndarray]:
        for a in range(0, len(some), TEXTS):
            rows = bits[some[a : a + TEXTS]]
            rows = (np.unpackbits(rows, axis=1) if packed else rows).astype(np.float32)
            rows /= np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)
            yield rows

    z = np.empty((len(chosen), bits.shape[1] * (8 if packed else 1)), dtype=np.float32)
    for k, rows in enumerate(units(chosen)):
        z[k * TEXTS : (k + 1) * TEXTS] = rows
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    k = np.concatenate([rows @ z.T for rows in units(np.arange(len(bits)))]).astype(np.float64)
    phi = k @ root
    y = np.where(languages[:, None] == np.array(names), 1.0, -1.0)
    share = np.array([np.mean(languages == name) for name in names])
    w = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ (y - (2 * share - 1)))
    weights = np.empty((z.shape[1], len(names)), dtype=np.float32)
    for a in range(0, len(weights), PLACES):
        weights[a : a + PLACES] = z[:, a : a + PLACES].T.astype(np.float64) @ (root @ w)
    return Model(names, weights)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; kernels and regressions are applied as batched matrix products."""
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    real = [texts[k] for k in known]
    for block in _blocks(real):
        bits = marks([real[k] for k in block]).astype(np.float32)
        out = (bits @ model.weights) / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))
        e = np.exp(SHARP * (out - out.max(1, keepdims=True)).astype(np.float64))
        best = out.argmax(1)
        p = e[np.arange(len(best)), best] / e.sum(1)
        for k, b, s in zip(block, best.tolist(), p.tolist(), strict=True):
            langs[known[k]], scores[known[k]] = model.languages[b], s
    return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is divisible by 5. A null id counts as such."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST, landmarks: int = LANDMARKS) -> Model | None:
    """The model learned from ``docs`` (doc_id, text, lang), or None if there is nothing to learn from.

    All documents that aren't held out and have a language and a letter count; of each
    language up to ``per_language`` texts are fitted on, the first by a hash of
    doc_id and text, and fewer of each where these were more than ``most`` in all. The
    sample's texts are read whole; only their marks come to the driver (2**BITS bits
    each). A language without a lettered text can't be learned; more than LANGUAGES are an error.
    """
    spark = small_batches(docs).sparkSession
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()  # a row a language
    if len(counts) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    if not counts:
        return None
    wanted = max(1, min(per_language, most // len(counts)))
    # the hash lets a few more than wanted through, and a language with few texts whole
    share = spark.createDataFrame([(r["lang"], min(1.0, (wanted + SPARE) / r["n"])) for r in counts], "of string, share double")
    hashed = labelled.withColumn("hash", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    some = hashed.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.col("hash") < F.col("share") * (1 << 30)).select("hash", "lang", "text")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[[has_letter(t) for t in rows["text"]]]
            texts = rows["text"].tolist()
            bits = [np.packbits(m).tobytes() for block in _blocks(texts) for m in marks([texts[k] for k in block])]
            yield pd.DataFrame({"hash": rows["hash"], "lang": rows["lang"], "bits": bits})

    own = Window.partitionBy("lang").orderBy("hash", "bits")
    first = some.mapInPandas(packed, "hash long, lang string, bits binary").withColumn("at", F.row_number().over(own)).where(F.col("at") <= wanted)
    got = first.toPandas().sort_values(["hash", "lang", "bits"])  # ``most`` rows, or one a language
    if got.empty:
        return None
    bits = np.frombuffer(b"".join(map(bytes, got["bits"])), dtype=np.uint8).reshape(len(got), -1)
    return fit(bits, got["lang"].to_numpy(dtype=str), landmarks, packed=True)


@F.pandas_udf(BooleanType())
def lettered(texts: pd.Series) -> pd.Series:
    """Whether a text has a letter, as ``predict`` asks; a null text has none."""
    return pd.Series([has_letter(t) for t in texts], dtype=bool)


def language(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """Column of ``docs`` with struct (lang_pred, score); it sees nothing but the text."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers a language

    @F.pandas_udf("lang_pred string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, scores = predict(part.tolist(), shared.value)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return of(F.col(text_col))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    A null, empty or blank text or one without a letter is ``und`` with score 0, as is every text
    if nothing could be learned. Texts of any length are read whole. Repeated rows get equal results; an empty table
    gives no rows; other columns are never looked at.
    """
    found = docs.select("doc_id", held_out().alias("held_out"), language(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
