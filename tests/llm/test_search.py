"""Decontamination, encoding and secrets against plain Python and the libraries they must equal."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import bpe, decontaminate, secrets
from riskloom.llm.queries import vocabulary
from tests.llm.test_text import plain_words


def plain_search(texts, items):
    windows = {}
    for name, s in items:
        w = plain_words(s)
        if w:
            k = min(10, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    out = []
    for s in texts:
        w, hit, found = plain_words(s), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_search_finds_what_comparing_all_windows_finds():
    rnd = random.Random(5)
    letters = ["a", "b", "Cé", "d1", "E", "漢"]
    for _ in range(120):
        items = [(str(i), " ".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 40])))) for i in range(rnd.randint(1, 6))]
        texts = [None, ""]
        for _ in range(rnd.randint(1, 8)):
            own = [rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 12, 200]))]
            own[len(own) // 2 : len(own) // 2] = rnd.choice(items)[1].split()
            texts.append(rnd.choice([" ", "-", "\n. "]).join(own))
        assert decontaminate.search(pa.array(texts, pa.string()), decontaminate.build(items)) == plain_search(texts, items)


def test_words_of_equal_hash_are_told_apart_by_their_spelling(monkeypatch):
    first = lambda data, begin, end: np.where(data[begin] == ord("z"), ord("j"), data[begin]).astype(np.uint64)
    monkeypatch.setattr("riskloom.llm.text.run_hashes", first)
    table = decontaminate.build([("x", "aa bb cc dd ee ff gg hh ii jj")])
    texts = ["aa bb cc dd ee ff gg hh ii jj kk", "aa bb cc dd ee ff gg hh ii zz"]
    assert [x[1:] for x in decontaminate.search(pa.array(texts), table)] == [(10, ["x"]), (0, [])]


def test_contamination_with_several_blocks_and_odd_rows(spark, odd, monkeypatch):
    rows = [(1, "two three four five six seven eight nine ten ELEVEN twelve"), (1, "two three four five six seven eight nine ten ELEVEN twelve"), (2, "word"), (3, None), (None, "lorem ipsum"), (4, "?!")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    assert decontaminate.blocks(items)[1] > 1
    found = {r.doc_id: r for r in decontaminate.with_hits(odd, items).where("doc_id is not null").collect()}
    assert (found[1]["_n_words"], found[1]["_n_hit"], found[1]["_items"]) == (12, 11, ["1"])
    assert found[5]["_items"] == ["2"] and found[3]["_n_words"] == found[4]["_n_words"] == 0
    assert found[8]["_items"] == ["null"] and found[8]["_n_hit"] == 120_000
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(odd.limit(0), items).count() == 0


@pytest.mark.parametrize("block_words", [1 << 20, 240])
def test_passes_find_what_one_block_finds(spark, odd, monkeypatch, block_words):
    """Items cut into pieces and dealt into blocks; a text that rows repeat, nulls, and old columns of the new names."""
    rnd = random.Random(7)
    draw = lambda n: " ".join(f"{rnd.choice('abcdé漢')}{rnd.randint(0, 300)}" for _ in range(n))
    items = [(str(i), draw(rnd.choice([3, 9, 10, 60, 700]))) for i in range(40)] + [("0", draw(50))]
    texts = [None, "", draw(500)]
    for _ in range(60):
        words = draw(rnd.randint(0, 80)).split()
        for _ in range(rnd.randint(0, 3)):
            own, at = rnd.choice(items)[1].split(), rnd.randint(0, len(words))
            lo = rnd.randint(0, max(0, len(own) - 10))
            words[at:at] = own[lo : lo + rnd.randint(8, 60)]
        texts += [rnd.choice([" ", " - ", "\n"]).join(words)] * rnd.choice([1, 1, 4])
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], "doc_id long, text string, _n_hit long, digest string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    tables, n = decontaminate.blocks(benchmark)
    assert (n > 1) == (block_words < 1000)
    got = {r.doc_id: r for r in decontaminate.with_hits(docs.repartition(4), benchmark).collect()}
    assert len(got) == len(texts) and {r["digest"] for r in got.values()} == {"x"}
    want = plain_search(texts, items)
    assert [(got[i]["_n_words"], got[i]["_n_hit"], got[i]["_items"]) for i in range(len(texts))] == want
    assert sum(hit > 0 for _, hit, _ in want) > 30


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    with open(vocabulary(), encoding="utf-8") as file:
        return Tokenizer.from_file(vocabulary()), bpe.Tokenizer(file.read())


def encoded(own, s):
    return [i for part in own.encode(s) for i in part.tolist()]


def test_ids_and_decoded_texts_are_those_of_the_library(both, documents, monkeypatch):
    library, own = both
    rnd = random.Random(3)
    letters = "ab 'sßΣσςİé é́  \n\t.,!<|startoftext|><|endoftext|>12٣漢字😀ǅ\x1c\x85\xa0'LL'S'Ve"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    texts += ["a<|endoftext|>b <|startoftext|>", "Σ ΑΣ ΑΣΑ", "x " * 70_000, "".join(rnd.choice("abcdefgh") for _ in range(5000)), ""]
    texts += [r.text for r in documents.collect()]
    for piece in (1 << 16, 7):
        monkeypatch.setattr(bpe, "PIECE_CHARS", piece)
        for s in texts:
            ids = library.encode(s, add_special_tokens=False).ids
            assert encoded(own, s) == ids
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tokens_of_odd_rows(odd):
    rows = bpe.with_tokens(odd, vocabulary()).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= {"score", "kept", "_ids", "_decoded"}
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert (by[3]["_ids"], by[3]["_decoded"]) == ([], "") and len(by[8]["_ids"]) >= 180_000
    assert bpe.with_tokens(odd.limit(0), vocabulary()).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain_spans(s):
    s = s or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(s) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(s) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(s) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


@pytest.fixture(scope="module")
def leaky(spark):
    rnd = random.Random(9)
    parts = ["token=", "SECRET : ", "'", '"', "api_key", "apikey=", "passwd", "abc", "AKIA", "ABCDEFGH", "0123456789abcdef", " ", "é漢😀", "=", ":", "x\n", "ABC"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "token=abcdef"), (402, "secret=token : abcdefgh"), (403, "token=abcdef"), (403, "token=abcdef"), (404, ("AKIA" + "Z" * 16 + " ") * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spans_are_those_of_the_patterns(leaky):
    want = sorted(((r.doc_id, plain_spans(r.text)) for r in leaky.collect()), key=repr)
    rows = secrets.secret_report(leaky).collect()
    assert sorted(((r.doc_id, r.spans) for r in rows), key=repr) == want
    assert all(r.n_assign + r.n_access + r.n_hex == (r.spans.count(",") + 1 if r.spans else 0) for r in rows)
    assert secrets.secret_report(leaky.limit(0)).count() == 0


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, leaky):
    old, new = leaky.where("doc_id < 200"), leaky
    first = secrets.record(old)
    added = secrets.scan(new, first)
    seen = {r.blob for r in first.collect()}
    assert seen and not {r.blob for r in added.collect()} & seen
    whole = secrets.record(new, first)
    assert secrets.scan(new, whole).count() == 0
    assert sorted(secrets.findings(new, whole).collect(), key=repr) == sorted(secrets.findings(new, secrets.record(new)).collect(), key=repr)
    changed = [*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{8,}", secrets.RULES[2].holds, version=2)]
    again = secrets.scan(new, whole, changed)
    assert {(r.kind, r.version) for r in again.collect()} == {("hex", 2)}
    # Findings of the new version replace those of the old one.
    found = secrets.findings(new, whole.unionByName(again), changed)
    assert found.agg({"n_hex": "sum"}).first()[0] > secrets.findings(new, whole).agg({"n_hex": "sum"}).first()[0]


def test_the_scan_runs_no_python(leaky):
    plan = secrets.scan(leaky)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
