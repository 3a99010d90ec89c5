"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

A word's symbols are a doubly linked list; a priority queue holds the rank of every adjacent pair, and an entry whose
pair has changed since is skipped when it comes up. Decoding joins vocabulary strings. A worker remembers a bounded
number of words. Texts of any length are encoded piece by piece, cut behind blanks, which no token spans. About a
hundred characters that Unicode gained in 2024 and 2025 are classed as the installed `regex` module has them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import small_batches, with_columns

WORDS_KEPT = 400_000  # words a worker remembers
PIECE_CHARS = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A word-end byte-pair vocabulary as its JSON file gives it."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the pair of the lowest rank is merged first, the leftmost of equals."""
        text = [self.symbols[b] for b in word.encode()]
        text[-1] += self.end
        n = len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.ranks.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if text[i] != left or j < 0 or text[j] != right:
                continue  # stale: one of the two has been merged since
            text[i], text[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((text[a], text[b]))) is not None:
                    heapq.heappush(queue, (r, a, text[a], text[b]))
        return tuple(self.ids[s] for s in text if s and s in self.ids)

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            found = self.encode_word(word)
            if len(word) < 256:
                self.known[word] = found
        return found

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text in order, one array for each piece of it."""
        at = 0
        while at < len(text):
            to = text.find(" ", at + PIECE_CHARS)
            to = len(text) if to < 0 else to + 1
            piece = text[at:to]
            at = to
            for k, part in enumerate(self.mark.split(piece)):
                if k % 2:
                    yield np.array([self.special[part]], np.int32)
                elif part:
                    if not unicodedata.is_normalized("NFC", part):
                        part = unicodedata.normalize("NFC", part)
                    # Lower case letter by letter: no special form of sigma at a word's end.
                    words = self.word.findall(part.replace("Σ", "σ").lower())
                    yield np.fromiter(chain.from_iterable(map(self._word, words)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by blanks, as a file without a decoder asks for; unknown ids are left out."""
        return " ".join([s for i in ids if (s := self.strings.get(i)) is not None])


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> Tokenizer:
    """One for a worker process, so that the words it remembers serve its later tasks too."""
    return Tokenizer(source)


def load(path: str) -> str:
    """The vocabulary file's text, read once on the driver; such a file has a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `_ids` (array of int) and `_decoded` for its text.

    Null text is empty: no ids, an empty decoded text. Strings of special tokens in a text become their ids. Nothing
    is truncated or padded. Repeated rows are encoded each; other columns pass through.
    """
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(load(path))

    def compute():
        tokenizer = _tokenizer(source.value)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            ends, parts, texts = [0], [np.zeros(0, np.int32)], []
            for text in batch.column("text").to_pylist():
                ids = np.concatenate([np.zeros(0, np.int32), *tokenizer.encode(text or "")])
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
                texts.append(tokenizer.decode(ids.tolist()))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts))), pa.array(texts, pa.string())]

        return columns

    return with_columns(docs, [("_ids", "array<int>"), ("_decoded", "string")], compute)


def digests() -> list:
    """Count and SHA-256 digests of what `with_tokens` adds, as columns."""
    return [
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    ]
