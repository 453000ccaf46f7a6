"""Token ids of whole texts from a public ``tokenizers`` file, with a memory of words.

The vocabulary used here drops white space and never merges across it, so the
ids of a text are the ids of its space-separated chunks, one after another.
Chunks repeat; a slice's distinct chunks are taken apart into lower-case words and marks,
and each worker process encodes such a unit once and keeps its ids. Whether a
vocabulary works like that is read from its file; others are encoded text by text.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from inodelake import runtime

#: Units remembered per generation and worker process; two generations are kept.
MEMORY = 400_000
#: Rows that Python gets at a time.
BATCH = 1024
#: Texts whose chunks are told apart at a time.
SLICE = 1024
#: Letters of one letter in NFC and in lower case, and ASCII marks other than the apostrophe: the split between both is one the vocabulary's own pattern makes.
LOWER = "".join(c for c in map(chr, [*range(128), *range(0xC0, 0x100)]) if c.islower())
LETTERS = "".join(c for c in map(chr, [*range(128), *range(0xC0, 0x100)]) if c.isalpha())
MARKS = string.punctuation.replace("'", "")
#: The characters by which the vocabulary shows those of LOWER's bytes that are none themselves.
SHOWN = [(chr(b), chr(256 + k)) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)) if b in LOWER.encode()]
#: A control character that is one id; it keeps units apart that are encoded as one text.
GLUE = "\x01"
END_OF_WORD = "</w>"
# The steps before the merges under which chunks are independent of each other.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def word_bpe() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_chunks(setup: dict) -> bool:
    """Whether a tokenizer file's steps are those under which a text's ids are its chunks' ids."""
    before = (setup.get("normalizer") or {}).get("normalizers"), (setup.get("pre_tokenizer") or {}).get("pretokenizers")
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or not t["content"].lstrip(LETTERS).strip(MARKS) for t in setup.get("added_tokens", []))
    return before == (NORMALIZER, [SPLIT, BYTES]) and plain and setup["model"].get("end_of_word_suffix") == END_OF_WORD and setup.get("truncation") is None


class WordTokenizer:
    """Encodes texts as unsigned 16-bit ids (32-bit ones for a larger vocabulary), exactly as ``encode(add_special_tokens=False)`` does."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(END_OF_WORD)]] = True
        with open(path, encoding="utf-8") as file:
            self.chunked = by_chunks(json.load(file))
        glue = self.tokenizer.encode(GLUE, add_special_tokens=False).ids
        self.glue = glue[0] if len(glue) == 1 and self.tokenizer.id_to_token(glue[0]).endswith(END_OF_WORD) else None
        self.merges = self.tokenizer.model.tokenize
        self.memory = memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _cut(self, ids: Sequence[int] | np.ndarray, ends: list[int], more: int = 0) -> list[bytes]:
        """``ids`` cut at ``ends``; the last ``more`` ids of each piece are left out."""
        raw, size = np.asarray(ids, dtype=self.kind).tobytes(), self.kind.itemsize
        return [raw[size * a : size * (b - more)] for a, b in zip([0, *ends], ends, strict=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of LOWER letters: all steps before the merges but the last leave them as they are."""
        ids: list[int] = []
        ends = []
        for word in words:
            if not word.isascii():
                word = word.encode().decode("latin-1")
                for byte, shown in SHOWN:
                    word = word.replace(byte, shown)
            ids += [t.id for t in self.merges(word)]
            ends.append(len(ids))
        return self._cut(ids, ends)

    def _together(self, chunks: list[str], glue: str, ends: Callable[[np.ndarray], np.ndarray], more: int) -> list[bytes]:
        """Ids of ``chunks``, encoded as one text with ``glue``, of ``more`` ids, between them and cut where ``ends`` says so."""
        if not chunks:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([glue.join(chunks)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cuts = [*(np.flatnonzero(ends(ids)) + 1).tolist(), *[len(ids) + more] * more]
        if len(cuts) != len(chunks):  # a letter that NFC or the lower case turns into more than letters
            return self._encode(chunks)
        return self._cut(ids, cuts, more)

    def _learn(self, new: list[str]) -> None:
        """Add the ids of ``new`` to the young generation."""
        know, old, plain, words, rest, odd = self.young, self.old, [], [], [], []
        for unit in new:
            if unit in old:
                know[unit] = old[unit]
            elif not unit.strip(LOWER):
                plain.append(unit)
            elif unit.isalpha():
                words.append(unit)
            elif self.glue is None or GLUE in unit:
                odd.append(unit)
            else:
                rest.append(unit)
        know.update(zip(plain, self._letters(plain), strict=True))
        know.update(zip(words, self._together(words, " ", self.ends.__getitem__, 0), strict=True))
        know.update(zip(rest, self._together(rest, f" {GLUE} ", lambda ids: ids == self.glue, 1), strict=True))
        know.update(zip(odd, self._encode(odd), strict=True))

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text of a list or an Arrow column; None counts as empty."""
        import pyarrow as pa

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [ids for at in range(0, len(column), SLICE) for ids in self._slice(column.slice(at, SLICE))]

    def _slice(self, column) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
        if not self.chunked:
            return [np.frombuffer(x, dtype=self.kind) for x in self._encode(column.to_pylist())]
        for mark in "\n\t\r":
            column = pc.replace_substring(column, mark, " ")
        lists = pc.split_pattern(column, " ")
        told = lists.flatten().dictionary_encode()
        # the distinct chunks' units: a lower-case word and its marks, or the chunk and nothing
        chunks = told.dictionary
        words = pc.utf8_rtrim(chunks, characters=MARKS)
        plain = pc.and_(pc.not_equal(words, ""), pc.equal(pc.utf8_ltrim(words, characters=LETTERS), ""))
        words = pc.if_else(plain, pc.utf8_lower(words), chunks)
        marks = pc.if_else(plain, pc.utf8_ltrim(chunks, characters=LETTERS), "")
        both = pa.chunked_array([words, marks]).combine_chunks().dictionary_encode()
        units = both.dictionary.to_numpy(zero_copy_only=False).tolist()
        know = self.young
        new = [u for u in units if u not in know]
        if new:
            self._learn(new)
        parts = [know[u] for u in units]
        if len(know) > self.memory:  # never within a slice: all its chunks are at hand
            self.old, self.young = know, {}
        # the ids of the distinct chunks, put together from those of their units, and of all chunks from these
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.kind.itemsize
        every = np.frombuffer(b"".join(parts), dtype=self.kind)
        pairs = both.indices.to_numpy().reshape(2, -1).T
        every, _ = _gathered(every, size, pairs.ravel())
        ids, ends = _gathered(every, size[pairs].sum(1), told.indices.to_numpy())
        cuts = np.concatenate([[0], ends])[np.cumsum(lists.value_lengths().to_numpy())[:-1]]
        return np.split(ids, cuts)


def _gathered(every: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces numbered ``at`` of ``every``, which holds pieces of ``size`` ids one after another, and where each of them ends."""
    first, length = np.cumsum(size) - size, size[at]
    ends = np.cumsum(length)
    return every[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + length, length)], ends


@cache
def tokenizer(path: str, memory: int = MEMORY) -> WordTokenizer:
    """One tokenizer for each worker process and file; later tasks find its memory filled."""
    return WordTokenizer(path, memory)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python at most BATCH rows and a few MB at a time: texts may be long."""
    runtime.small_batches(df.sparkSession, BATCH)
    return df
