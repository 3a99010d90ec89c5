import random
import re

import numpy as np
import pyarrow as pa

from riskloom.llm import text

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(s):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))


def test_words_are_those_of_the_pattern():
    rnd = random.Random(1)
    for _ in range(100):
        texts = ["".join(rnd.choice("aB 1.é漢-") for _ in range(rnd.randint(0, 50))) for _ in range(4)] + [None, ""]
        words = text.Words(pa.array(texts, pa.string()))
        raw = words.data.tobytes()
        for i, s in enumerate(texts):
            own = slice(words.first[i], words.first[i + 1])
            assert [raw[b:e].decode() for b, e in zip(words.begin[own], words.end[own])] == plain_words(s)


def test_equal_words_have_equal_hashes_in_any_piece(monkeypatch):
    column = pa.array([" ".join(f"w{i % 977}" for i in range(5000)), "w1 w2"])
    whole = text.Words(column).hash
    monkeypatch.setattr(text, "PIECE", 100)
    assert np.array_equal(text.Words(column).hash, whole)
    assert len(set(whole.tolist())) == 977


def test_a_sliced_column_reads_its_own_rows():
    column = pa.array(["ab", None, "cd ef", "g"]).slice(2)
    words = text.Words(column)
    assert words.first.tolist() == [0, 2, 3]


def test_short_texts_are_one_shingle():
    words = text.Words(pa.array(["a b c", "a b c d e f"]))
    assert len(text.shingle_hashes(words.hash[:3], 5)) == 1
    assert len(text.shingle_hashes(words.hash[3:], 5)) == 2
    assert len(text.shingle_hashes(words.hash[:0], 5)) == 0
