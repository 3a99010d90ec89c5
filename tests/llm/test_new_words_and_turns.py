"""Spelling variants, conversation tries and uniform shards against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import shards, spelling, trie


# ---------------------------------------------------------------- spelling
def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and plain_near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(df, **how):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def misspelt():
    rnd = random.Random(3)
    bases = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randint(7, 10))) for _ in range(40)] + ["aaaaaaaa", "x" * 400]
    words = []
    for base in bases:
        words += [base] * rnd.choice((2, 30, 400))
        for _ in range(12):
            i = rnd.randrange(len(base))
            edited = rnd.choice((base[:i] + base[i + 1 :], base[:i] + rnd.choice("abc") + base[i:], base[:i] + rnd.choice("abcé") + base[i + 1 :]))
            words += [edited] * rnd.choice((2, 3, 25))
            words += ["".join(rnd.sample(base, len(base)))] * 2  # anagrams: the same vector, seldom near
    rnd.shuffle(words)
    docs = [(i, " ".join(words[i::60]).title() if i % 2 else "-".join(words[i::60])) for i in range(60)]
    return [*docs, (None, "Abcdefgh ABCDEFGH abcdefgh ×÷×÷×÷× ×÷×÷×÷×"), (61, None), (62, ""), (0, docs[0][1])]


@pytest.mark.parametrize("how", [{}, {"cell": 16, "sample": 100}, {"cell": 1, "sample": 10**6}])
def test_variants_agree_with_all_pairs(spark, misspelt, how):
    found = variants(spark.createDataFrame(misspelt, "doc_id long, text string"), **how)
    assert found == plain_variants(misspelt)
    assert any(r[1] for r in found) and any(r[2] not in (r[0], r[1]) for r in found)


def test_variants_of_the_documents(documents):
    assert variants(documents, cell=50) == plain_variants([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_variants_of_odd_rows_and_none(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    clashing = odd.withColumnsRenamed({"lang": "word", "score": "n", "kept": "home"})
    assert variants(clashing) == plain_variants(rows)
    assert variants(odd.limit(0)) == []


def test_trees_reach_every_near_vector():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(7, 9))) for _ in range(600)})
    v = spelling.Vectors(pa.array(words))
    tree = spelling.Tree.over(v.axes, v.size, 8)
    home = tree.homes(v.axes, v.size)
    assert tree.boxes > 30 and set(home.tolist()) <= set(range(tree.boxes))
    for longer in (False, True):
        reached = defaultdict(set)
        for box, rows in tree.reach(v.axes, v.size, longer):
            for i in rows.tolist():
                assert box not in reached[i]
                reached[i].add(box)
        near = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) == len(a) + longer and plain_near(a, b)]
        assert near and all(int(home[j]) in reached[i] for i, j in near)
        assert np.mean([len(reached[i]) for i in range(len(words))]) < tree.boxes / 2


# ------------------------------------------------------------- conversations
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32], (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        members[c] = own.get(c - math.trunc(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for path, cs in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(cs) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
    out = []
    for path, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(members[c]) == len(path))))
        out.append((min(cs), len(path), min(nodes[path[:-1]]) if path else None, len(cs), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TALK = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(7)
    say = [f"word{i} and {'more ' * (i % 4)}" for i in range(6)]
    rows = []
    for c in range(-25, 300):
        n = rnd.choice((0, 1, 1, 2, 3, 5, 8)) if c % 3 else 3
        for t in range(n):
            role = rnd.choice(("user", None, "assistant")) if c % 7 == 0 else "user"
            rows.append((c, t, role, rnd.choice(say[: 1 + t % 6]) if c % 3 else say[t]))
    long = [(c, t, "user", say[t % 5] if t < 80 else f"{c}") for c in (400, 401, 402) for t in range(100)]
    odd = [(500, None, None, None), (500, None, None, None), (500, 1, "", ""), (500, 1, "user", "tie"), (500, 1, "system", "tie"), (None, 1, "user", "lost"), (501, -3, "user", "\t \n")]
    return [*rows, *long, *odd]


@pytest.mark.parametrize("most", [1, 40, 1 << 14])
def test_trie_agrees_with_plain_prefixes(spark, talk, most):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = trie.conversation_trie(spark.createDataFrame(talk, TALK).repartition(5), most)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == plain_trie(talk)


def test_trie_of_nothing_and_of_clashing_columns(spark, talk):
    empty = spark.createDataFrame([], TALK)
    assert trie.conversation_trie(empty).count() == 0
    wide = spark.createDataFrame(talk[:50], TALK).selectExpr("*", "'x' as ids", "1 as words", "2 as depth", "3 as home")
    assert trie.conversation_trie(wide).count() == len(plain_trie(talk[:50]))


def test_lists_of_ids_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    members = spark.createDataFrame([(c, b"a" * 16) for c in range(-10, 30)] + [(99, b"")], "conv_id long, ids binary")
    ends = {r.ends for r in trie._ends(members).collect()}
    assert ends == {hashlib.sha256(",".join(map(str, range(-10, 30))).encode()).hexdigest(), hashlib.sha256(b"99").hexdigest()}


# ------------------------------------------------------------------- shards
@pytest.mark.parametrize("rows", [0, 1, 7, 8, 1003])
def test_shards_have_exact_sizes_and_gapless_places(spark, rows):
    df = spark.range(rows).repartition(6).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'same' as text", "doc_id as lane", "1 as p")
    out = shards.uniform_shards(df, lane_rows=40).collect()
    assert sorted(r.doc_id for r in out) == list(range(rows))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert set(slots) <= set(range(8)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shard_report_of_odd_rows(spark, odd):
    out = shards.shard_report(odd)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out.collect()), key=repr) == want
    with pytest.raises(ValueError, match="slot"):
        shards.uniform_shards(odd.withColumn("slot", odd["doc_id"]))


def test_every_place_is_as_likely(spark):
    """Of 24 rows in partitions of very different sizes, each should be in each shard, and first there, equally often."""
    df = spark.createDataFrame([(i,) for i in range(24)], "i int").selectExpr("i").repartitionByRange(4, "i")
    shard, first = np.zeros((24, 3)), np.zeros(24)
    trials = 60
    for seed in range(trials):
        for r in shards.uniform_shards(df, 3, seed=1000 + seed).collect():
            shard[r.i, r.shard] += 1
            first[r.i] += r.slot == 0
    assert (shard.sum(axis=1) == trials).all()
    # Sums of squares over expected counts: 48 and 23 degrees of freedom, with bounds beyond the 0.9999 quantiles.
    assert ((shard - trials / 3) ** 2 / (trials / 3)).sum() < 48 + 5 * math.sqrt(96)
    assert ((first - trials / 8) ** 2 / (trials / 8)).sum() < 23 + 5 * math.sqrt(46)


def test_rows_of_the_matrix_add_up():
    counts, targets = np.array([5, 0, 17, 1, 40, 0, 3]), shards.lane_sizes(66, 8, 3)
    assert targets.sum() == 66 and np.ptp(targets.reshape(8, 3).sum(axis=1)) <= 1
    matrix = np.array([shards.matrix_row(counts, targets, p, 9) for p in range(len(counts))])
    assert (matrix.sum(axis=1) == counts).all() and (matrix.sum(axis=0) == targets).all() and (matrix >= 0).all()
    large = np.array([3 * 10**9, 2 * 10**9 + 1])
    parts = [shards.matrix_row(large, shards.lane_sizes(int(large.sum()), 4, 1), p, 9) for p in (0, 1)]
    assert [int(p.sum()) for p in parts] == large.tolist()


@pytest.mark.parametrize(("good", "bad", "drawn"), [(5, 7, 6), (40, 400, 100), (3, 1000, 500), (300, 20, 200)])
def test_draws_beyond_numpy_have_the_right_odds(good, bad, drawn):
    rng, n = np.random.default_rng(4), 20_000
    got = Counter(shards.hypergeometric(rng, good, bad, drawn, numpy_most=0) for _ in range(n))
    odds = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
    assert set(got) <= set(odds)
    assert all(abs(got[k] - n * p) < 5 * math.sqrt(n * p + 1) for k, p in odds.items())


def test_draws_of_billions_are_centred():
    rng = np.random.default_rng(1)
    got = [shards.hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**10) for _ in range(300)]
    deviation = math.sqrt(10**10 * 0.4 * 0.6 * 0.99)
    assert abs(np.mean(got) - 4 * 10**9) < 5 * deviation / math.sqrt(300) and 0.8 < np.std(got) / deviation < 1.2
