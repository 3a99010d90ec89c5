"""Exact and near de-duplication against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import exact, near
from tests.llm.test_text import plain_words


def test_exact_groups_of_odd_rows(odd):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    # The row without an id has one more character, so it stays and the others go.
    assert [(r.keep_id, r.group_size, r.kept) for r in by[1]] == [(None, 4, False)]
    assert sorted(r.kept for r in by[2]) == [False, False]
    empty = hashlib.sha256(b"").hexdigest()
    # Null and empty texts are one group; white space and nothing else would be too.
    assert {(r.keep_id, r.group_size, r.text_sha256) for i in (3, 4) for r in by[i]} == {(3, 3, empty)}
    assert sum(r.kept for r in rows if r.text_sha256 == empty) == 1


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b"), (2, "a b"), (1, "ab"), (3, "c")], "doc_id long, text string")
    rows = exact.exact_groups(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect()) == [(1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True)]
    assert sorted(r.doc_id for r in exact.only_kept(docs, rows).collect()) == [2, 3]


def test_clashing_identifiers_are_found_and_replaced(documents):
    salt, size = exact.verified_size(documents, first_size=1)
    assert size > 1
    few, many = (exact.exact_groups(documents, s).orderBy("doc_id").collect() for s in (1, 16))
    assert few == many


def test_cuts_depend_on_content_and_cover_it():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 300_000).astype(np.uint8)
    ends = exact.cuts(body)
    assert ends[-1] == len(body) and all(0 < b - a <= exact.MOST for a, b in zip([0, *ends], ends))
    moved = exact.cuts(np.concatenate([body[:10], body]))
    assert len({e + 10 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert exact.cuts(body[:0]) == [] and exact.cuts(body[:5]) == [5]


def test_cuts_do_not_depend_on_steps(monkeypatch):
    body = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    whole = exact.cuts(body)
    monkeypatch.setattr(exact, "STEP", 1000)
    assert exact.cuts(body) == whole


def test_exact_groups_of_nothing(documents):
    assert exact.exact_groups(documents.limit(0)).count() == 0


def plain_bag(s):
    w = plain_words(s)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(docs):
    """Components of the graph of all pairs whose weighted Jaccard similarity is at least 0.8, by brute force.

    A shingle weighs its count times 1 + ln((N + 1) / df) / (4 ln(N + 2)), for N texts with words and df texts that have it.
    """
    bags = {doc_id: plain_bag(s) for doc_id, s in docs}
    holders = defaultdict(set)
    for doc_id, bag in bags.items():
        for x in bag:
            holders[x].add(doc_id)
    total = sum(1 for b in bags.values() if b)
    weight = {x: 1 + 0.25 * math.log((total + 1) / len(d)) / math.log(total + 2) for x, d in holders.items()}
    mass = {d: sum(k * weight[x] for x, k in b.items()) for d, b in bags.items()}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in set().union(*(holders[x] for x in bags[a])):
            if a < b and min(mass[a], mass[b]) >= 0.79 * max(mass[a], mass[b]):
                both = sum(min(k, bags[b][x]) * weight[x] for x, k in bags[a].items() if x in bags[b])
                similar = both / (mass[a] + mass[b] - both)
                assert abs(similar - 0.8) > 0.0005  # the frequencies of the operator may be off by as much
                if similar > 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in bags}


@pytest.fixture(scope="module")
def edited(spark):
    """A large group of near copies of one text, chains of edits, and texts apart from them that share a passage."""
    rnd = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rnd.integers(0, 26, 6))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(30)], []
    for i in range(60):
        own = list(base)
        for j in rnd.choice(120, 1 + i % 2, replace=False):
            own[j] = word()
        rows.append((i, " ".join(own)))
    chain = [word() for _ in range(150)]
    for i in range(100, 110):
        rows.append((i, " ".join(chain)))
        chain[(i * 13) % 150] = word()
    rows += [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(200, 240)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_classes_are_the_components_of_similar_pairs(edited, documents):
    for docs in (edited, documents):
        want = plain_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        sizes = Counter(want.values())
        got = near.near_classes(docs).collect()
        assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got} == {d: (c, sizes[c], d == c) for d, c in want.items()}


def test_pairs_are_found_among_many_texts_that_share_a_passage(spark):
    """The pairs share few bands, most of them with the texts that have the passage and are not similar."""
    rnd = np.random.default_rng(5)
    words = lambda n: ["".join(chr(97 + c) for c in w) for w in rnd.integers(0, 26, (n, 6))]
    passage, rows = words(352), []
    for i in range(30):
        both = words(18)
        rows += [(2 * i + j, " ".join(passage + both + words(30))) for j in (0, 1)]
    rows += [(i, " ".join(passage + words(48))) for i in range(60, 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    inverse = near.inverse_frequencies(docs)
    bags = near.Bags(pa.array([t for _, t in rows[:62]]))
    own = [(bags.hash[a:b], bags.weights(inverse)[a:b]) for a, b in zip(bags.first[:-1], bags.first[1:])]
    assert all(near.similarity(own[2 * i], own[2 * i + 1]) >= near.SIMILAR for i in range(30)) and near.similarity(own[60], own[61]) < 0.79
    got = {r.doc_id: (r.class_id, r.class_size) for r in near.near_classes(docs).collect()}
    assert got == {i: (i - i % 2, 2) if i < 60 else (i, 1) for i, _ in rows}


def test_near_classes_of_odd_rows(odd):
    rows = near.near_classes(odd).collect()
    assert len(rows) == odd.count()
    size = {r.doc_id: r.class_size for r in rows}
    assert size[1] == size[2] == 4 and size[3] == size[4] == size[6] == 1
    assert [r.class_id for r in rows if r.doc_id == 2] == [1, 1]
    assert sorted(r.class_id or -1 for r in rows if r.doc_id is None) == [-1, 1]
    # The null row without words is a class of its own and stays; of the class of equal texts row 1 does.
    assert {r.doc_id for r in exact.only_kept(odd, near.near_classes(odd)).collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9}


def test_rows_that_share_a_doc_id_are_decided_one_by_one(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same), (1, "quite another text of more than five words"), (None, same), (None, same + " "), (1, same), (2, same.upper()), (None, "a text that nobody else has at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near_rows = near.near_classes(docs)
    assert sum(r.kept for r in near_rows.collect()) == 3
    assert sorted((r.doc_id or 0, r.text) for r in exact.only_kept(docs, near_rows).collect()) == sorted([(0, rows[6][1]), (1, same), (1, rows[1][1])])
    groups = exact.exact_groups(docs)
    assert sum(r.kept for r in groups.collect()) == 4
    assert sorted((r.doc_id or 0, r.text) for r in exact.only_kept(docs, groups).collect()) == sorted([(0, rows[6][1]), (0, same + " "), (1, rows[1][1]), (2, same.upper())])
    unnamed = spark.createDataFrame([(None, same), (None, same + " x")] * 2, "doc_id long, text string")
    assert exact.only_kept(unnamed, near.near_classes(unnamed)).count() in (1, 2) and sum(r.kept for r in near.near_classes(unnamed).collect()) == exact.only_kept(unnamed, near.near_classes(unnamed)).count()


def test_texts_that_share_a_template_do_not_meet(spark):
    """Candidates grow with the texts, not with their square: the shared shingles fall behind the prefix."""
    rnd = np.random.default_rng(6)
    words = lambda n: ["".join(chr(97 + c) for c in w) for w in rnd.integers(0, 26, (n, 6))]
    passage = words(352)
    found = []
    for n in (100, 400):
        rows = [(bytes([1]) * 8 + i.to_bytes(8, "big"), " ".join(passage + words(48))) for i in range(n)]
        rows += [(bytes([2]) * 8 + i.to_bytes(8, "big"), rows[i][1].rsplit(" ", 3)[0] + " x y z") for i in range(5)]
        members = spark.createDataFrame([(k, k, t) for k, t in rows], "key binary, class binary, text string")
        inverse = spark.sparkContext.broadcast(near.inverse_frequencies(members.select("text")))
        pairs = {frozenset((bytes(r.key)[8:], bytes(r.chief)[8:])) for r in near._prefix_pairs(members, inverse).collect()}
        assert all(frozenset([i.to_bytes(8, "big")]) in pairs for i in range(5))
        found.append(len(pairs))
    assert found[0] < 100 and found[1] < 400


def test_near_classes_of_nothing(documents):
    assert near.near_classes(documents.limit(0)).count() == 0


def test_samples_agree_as_often_as_bags_are_similar():
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(600, 3600))
    bags = near.Bags(pa.array([a, b]))
    weights = bags.weights(np.ones(1 << near.SKETCH_BITS))
    marks = near.samples(bags, weights)
    own = [(bags.hash[x:y], weights[x:y]) for x, y in zip(bags.first[:-1], bags.first[1:])]
    assert abs((marks[:, 0] == marks[:, 1]).mean() - near.similarity(*own)) < 0.2


def test_hardly_a_pair_near_the_threshold_shares_no_band():
    assert (1 - near.SIMILAR**near.BAND_SAMPLES) ** near.BANDS < 0.00025


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 50), (60, 60), (7, 3)]
    found = near.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 21)} | {50: 40, 41: 40}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_white_space_is_what_the_contract_deletes():
    assert re.sub(r"[\x20\x09-\x0D]", "", "a\x0b\x0c\r\n\t b\xa0") == "ab\xa0"
    (pair,) = exact._normal(pa.array(["a\x0b\x0c\r\n\t b\xa0"]))
    assert pair[0] == 9 and pair[1].tobytes().decode() == "ab\xa0"
