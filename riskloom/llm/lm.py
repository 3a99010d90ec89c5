"""Language-model scores by stupid backoff, from count tables that are partitioned by a hash of the n-gram.

A word pair that some other document has too scores its count over the count of its first word; any other pair backs
off to BACKOFF times the share of its second word, and a text's first word scores its share. A document's score is the
mean of the logarithms. All counts cover all documents.

Every word and every pair keeps its own count. Words at least as frequent as one in 2**VOCABULARY_BITS are at most that
many whatever the corpus: their counts go to every task, which names them by entry numbers. So do pairs more frequent
than one in 2**FREQUENT_BITS, which are scored where they stand. All else travels once, packed, to where it is counted:
a pair of two frequent words to the partition that its key's hash names, a rare word and the pairs it is part of to the
partition that the word's hash names. A pair of two rare words goes to both; each adds its own word's part of the score.
Nothing that travels can fill a partition, since none of it is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import Words, mixed, pieces, small_batches
from riskloom.session import checkpointed

BACKOFF = 0.4
VOCABULARY_BITS = 21
FREQUENT_BITS = 20
SKETCH_BITS = 20  # cells that find candidates for frequent pairs
PAIRS_PER_GROUP = 1_500_000  # words of text for each partition of the count table
FIRST, SECOND, ALONE = 0, 1, 2  # how a rare word stands in what is counted: in a pair, or itself
PIECE = 4 << 20
# A row is a chunk's documents (doc_ids, sizes and their scores so far in `base`) or its pairs in one partition: keys of
# frequent words in `pairs`, or hashes of rare words in `rare`, what they occur in as `uses` (place in `rare` x 4 + how
# they stand) and the hash of each pair's other word in `others`.
PACKED_ROW = "part long, chunk long, doc_ids array<long>, sizes array<long>, base binary, texts binary, pairs binary, times binary, rare binary, uses binary, others binary"
REPLY_ROW = "chunk long, doc_ids array<long>, sizes array<long>, base binary, texts binary"
_KINDS = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
PACKED, REPLY = (pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in row.split(", "))]) for row in (PACKED_ROW, REPLY_ROW))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9FB21C651E98DF25) ^ second, 100)


def _inside(words: Words) -> np.ndarray:
    """Positions of words that have a word before them in their text."""
    inside = np.ones(len(words.hash), bool)
    inside[words.first[:-1][words.first[:-1] < len(words.hash)]] = False
    return np.flatnonzero(inside)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by hash (kind 0) and, at the end of a task, of all pairs by sketch cell (kind 1)."""
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            words = Words(batch.column("text"))
            distinct, n = np.unique(words.hash, return_counts=True)
            at = _inside(words)
            if len(at):
                cell = _pair_hash(words.hash[at - 1], words.hash[at]) >> np.uint64(64 - SKETCH_BITS)
                cells += np.bincount(cell.astype(np.int64), minlength=len(cells))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(distinct.view(np.int64)), pa.array(n)], ["kind", "at", "n"])
    used = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(cells[used])], ["kind", "at", "n"])


class Vocabulary:
    """Entry numbers and counts of frequent words; the entry number after the last is that of every rare word."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order], total
        bits = max(1, math.ceil(math.log2(len(hashes) + 2)))
        self.shift = np.uint64(64 - bits)
        heads = np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(self.hashes, heads[:-1]), len(hashes))

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        head = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        out = np.full(len(hashes), self.rare, np.int64)
        going = np.flatnonzero(at < end)
        while len(going):
            place = at[going]
            same = self.hashes[place] == hashes[going]
            out[going[same]] = place[same]
            at[going] += 1
            going = going[~same & (at[going] < end[going])]
        return out

    @property
    def rare(self) -> int:
        return len(self.hashes)

    @property
    def size(self) -> int:
        return len(self.hashes) + 1


def _document_pairs(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry of each word; document, key and times of each pair of frequent words a document has, by document and key."""
    entry = vocabulary.entries(words.hash)
    at = _inside(words)
    at = at[(entry[at - 1] != vocabulary.rare) & (entry[at] != vocabulary.rare)]
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[at]
    key = entry[at - 1] * np.int64(vocabulary.size) + entry[at]
    bounds = np.searchsorted(text, np.arange(len(words.first))).tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        key[a:b].sort()  # text numbers ascend already
    heads = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    return entry, text[heads], key[heads], np.diff(np.append(heads, len(key)))


def _rare_uses(words: Words, entry: np.ndarray, rare: int, parts: int) -> tuple[np.ndarray, ...]:
    """Partition, hash of the rare word, how it stands, hash of the other word, document and times, in that order."""
    at = _inside(words)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    alone, first, second = np.flatnonzero(entry == rare), at[entry[at - 1] == rare], at[entry[at] == rare]
    word = np.concatenate([words.hash[alone], words.hash[first - 1], words.hash[second]])
    other = np.concatenate([np.zeros(len(alone), np.uint64), words.hash[first], words.hash[second - 1]])
    stands = np.repeat(np.array([ALONE, FIRST, SECOND]), [len(alone), len(first), len(second)])
    text = np.concatenate([text[alone], text[first], text[second]])
    part = (mixed(word, 101) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((text, other, stands, word, part))
    columns = [c[order] for c in (part, word, stands, other, text)]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return *(c[heads] for c in columns), np.diff(np.append(heads, len(order)))


def gains(vocabulary: Vocabulary, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What a pair seen elsewhere adds to the score that backing off would give: log of count over first word's count, less that."""
    first, second = key // vocabulary.size, key % vocabulary.size
    backed = BACKOFF * vocabulary.counts[second] / vocabulary.total
    return np.log(count / vocabulary.counts[first]) - np.log(backed)


def _scored_rows(vocabulary, frequent, parts: int):
    """For each chunk of documents a row with their scores as if all pairs but the frequent ones backed off, and a row
    for each partition with the other pairs.

    A chunk is named by its task and its place in it, so a task that runs again names it alike.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        keys, counts = frequent.value
        share = np.append(np.log(v.counts / v.total), 0.0)  # rare words get theirs where they are counted
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words = Words(batch.column("text"))
                n = batch.num_rows
                entry, text, key, times = _document_pairs(words, v)
                size = np.diff(words.first)
                owner = np.repeat(np.arange(n), size)
                total = np.bincount(owner, weights=share[entry], minlength=n) + np.maximum(size - 1, 0) * math.log(BACKOFF)
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                good = known.copy()
                good[known] = counts[at[known]] > times[known]
                total += np.bincount(text[good], weights=times[good] * gains(v, key[good], counts[at[good]]), minlength=n)
                text, key, times = text[~known], key[~known], times[~known]
                part = (mixed(key.view(np.uint64), 101) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                text, key, times, part = text[order], key[order], times[order], part[order]
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                ids = batch.column("doc_id")
                out = [(chunk % parts, ids.to_pylist(), size.tolist(), total.tobytes())]
                for a, b in zip(heads.tolist(), np.append(heads[1:], len(part)).tolist()):
                    own = (text[a:b].astype(np.uint16), _six_bytes(key[a:b]), times[a:b].astype(np.uint32))
                    out.append((int(part[a]), None, None, None, *(x.tobytes() for x in own)))
                part, word, stands, other, text, times = _rare_uses(words, entry, v.rare, parts)
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(heads.tolist(), np.append(heads[1:], len(part)).tolist()):
                    distinct, place = np.unique(word[a:b], return_inverse=True)
                    uses = (place * 4 + stands[a:b]).astype(np.uint32)
                    own = (text[a:b].astype(np.uint16), b"", times[a:b].astype(np.uint32), distinct, uses, other[a:b])
                    out.append((int(part[a]), None, None, None, *(x if isinstance(x, bytes) else x.tobytes() for x in own)))
                yield pa.RecordBatch.from_pylist([dict(zip(PACKED.names, (r[0], chunk, *r[1:]))) for r in out], schema=PACKED)
                chunk += 1

    return rows


def _six_bytes(key: np.ndarray) -> np.ndarray:
    """Keys in 48 bits: two entry numbers have 2 x VOCABULARY_BITS and a little."""
    return key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _sums_by_text(chunks, ends: np.ndarray, text: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """For each row (whose items end at `ends`) its chunk and, of texts with a sum other than 0, numbers and sums."""
    for chunk, a, b in zip(chunks, [0, *ends[:-1].tolist()], ends.tolist()):
        total = np.bincount(text[a:b], weights=value[a:b])
        some = np.flatnonzero(total)
        if len(some):
            yield chunk, some.astype(np.uint16).tobytes(), total[some].tobytes()


def _rare_gains(v: Vocabulary, word: np.ndarray, stands: np.ndarray, other: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What each use of a rare word adds to its document's score. All uses of a word are here, and so its counts."""
    distinct, at = np.unique(word, return_inverse=True)
    alone = stands == ALONE
    log_count = np.log(np.bincount(at[alone], weights=times[alone], minlength=len(distinct)))[at] if len(at) else np.zeros(0)
    value = np.where(alone, times * (log_count - math.log(v.total)), 0.0)
    pair = np.flatnonzero(~alone)
    pair = pair[np.lexsort((other[pair], at[pair] * 2 + stands[pair]))]
    if len(pair):
        new = np.ones(len(pair), bool)
        new[1:] = (other[pair][1:] != other[pair][:-1]) | (at[pair][1:] != at[pair][:-1]) | (stands[pair][1:] != stands[pair][:-1])
        heads = np.flatnonzero(new)
        each = np.repeat(np.add.reduceat(times[pair], heads), np.diff(np.append(heads, len(pair))))
        pair, each = pair[each > times[pair]], each[each > times[pair]]
        entry = v.entries(other[pair])
        known = entry != v.rare
        # The partition of a pair's first word adds what both words share, or the only one that has a rare word of it.
        whole = known | (stands[pair] == FIRST)
        gain = np.where(whole, np.log(each) - math.log(BACKOFF) + math.log(v.total), 0.0) - log_count[pair]
        gain[known] -= np.log(v.counts[entry[known]])
        value[pair] = times[pair] * gain
    return value


def _counted_rows(vocabulary):
    """For one partition of the count table: what pairs that other documents have too add to each document of a chunk.

    Rows of chunks pass through to the next step.
    """

    def rows(group: pa.Table) -> pa.Table:
        v = vocabulary.value
        based = pc.is_valid(group.column("base"))
        chunks = group.filter(based)
        group = group.filter(pc.invert(based))
        with_rare = pc.is_valid(group.column("rare"))
        rares, group = group.filter(with_rare), group.filter(pc.invert(with_rare))
        raw = group.column("pairs").to_pylist()
        key = np.concatenate([_keys(x) for x in raw] or [np.zeros(0, np.int64)])
        times = np.frombuffer(b"".join(group.column("times").to_pylist()), np.uint32).astype(np.int64)
        text = np.frombuffer(b"".join(group.column("texts").to_pylist()), np.uint16)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        each = np.empty(len(key), np.int64)
        if len(heads):
            each[order] = np.repeat(np.add.reduceat(times[order], heads), np.diff(np.append(heads, len(key))))
        elsewhere = each > times
        gain = np.zeros(len(key))
        gain[elsewhere] = times[elsewhere] * gains(v, key[elsewhere], each[elsewhere])
        found = list(_sums_by_text(group.column("chunk").to_pylist(), np.cumsum([len(x) // 6 for x in raw]), text, gain))
        del raw, key, times, text, order, each, gain
        used, named = rares.column("uses").to_pylist(), rares.column("rare").to_pylist()
        if used:
            uses = np.frombuffer(b"".join(used), np.uint32).astype(np.int64)
            starts = np.cumsum([0, *(len(x) // 8 for x in named[:-1])])
            places = uses // 4 + np.repeat(starts, [len(x) // 4 for x in used])
            word, other = np.frombuffer(b"".join(named), np.uint64)[places], np.frombuffer(b"".join(rares.column("others").to_pylist()), np.uint64)
            times = np.frombuffer(b"".join(rares.column("times").to_pylist()), np.uint32).astype(np.int64)
            text = np.frombuffer(b"".join(rares.column("texts").to_pylist()), np.uint16)
            value = _rare_gains(v, word, uses % 4, other, times)
            found += _sums_by_text(rares.column("chunk").to_pylist(), np.cumsum([len(x) // 4 for x in used]), text, value)
        names, texts, added = zip(*found) if found else ([], [], [])
        replies = pa.table({"chunk": pa.array(names, pa.int64()), "texts": pa.array(texts, pa.binary()), "base": pa.array(added, pa.binary())})
        return pa.concat_tables([chunks.select(["chunk", "doc_ids", "sizes", "base", "texts"]), replies], promote_options="default").select(REPLY.names).cast(REPLY)

    return rows


def _summed_rows(group: pa.Table) -> pa.Table:
    """One chunk's documents with their scores."""
    base = group.filter(pc.is_valid(group.column("doc_ids")))
    total = np.frombuffer(base.column("base")[0].as_py(), np.float64).copy()
    size = np.asarray(base.column("sizes")[0].values, np.int64)
    replies = group.filter(pc.is_null(group.column("doc_ids")))
    order = np.argsort([x[:64] for x in replies.column("base").to_pylist()]) if len(replies) else []
    texts, added = replies.column("texts").to_pylist(), replies.column("base").to_pylist()
    for i in order:
        total[np.frombuffer(texts[i], np.uint16)] += np.frombuffer(added[i], np.float64)
    ids = base.column("doc_ids")[0].values
    score = pa.array(total / np.maximum(size, 1), mask=size == 0)
    return pa.table({"doc_id": ids, "n_words": pa.array(size), "score": score})


def _frequent_rows(vocabulary, cells):
    """Counts of pairs that fall into cells which may hold a frequent one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = vocabulary.value, cells.value
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words = Words(batch.column("text"))
                at = _inside(words)
                cell = (_pair_hash(words.hash[at - 1], words.hash[at]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                at = at[hot[cell]]
                first, second = v.entries(words.hash[at - 1]), v.entries(words.hash[at])
                both = (first != v.rare) & (second != v.rare)  # a pair is at most as frequent as its words
                distinct, n = np.unique(first[both] * np.int64(v.size) + second[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], ["pair", "n"])

    return rows


def backoff_scores(docs: DataFrame, vocabulary_bits: int = VOCABULARY_BITS, frequent_bits: int = FREQUENT_BITS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, score (mean log score, null without words).

    Null text has no words. Every row is a document of its own, so pairs of a repeated row are pairs that another
    document has. A null doc_id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = checkpointed(docs.select("text").mapInArrow(_word_rows, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")))
    total = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("double").alias("score"))
    # At most 2**vocabulary_bits words can reach this count, and 2**SKETCH_BITS cells exist.
    least = total / 2**vocabulary_bits
    words = counted.where((F.col("kind") == 0) & (F.col("n") >= least)).select("at", "n").toArrow()
    v = Vocabulary(np.asarray(words.column("at"), np.int64).view(np.uint64), np.asarray(words.column("n"), np.int64), int(total))
    vocabulary = spark.sparkContext.broadcast(v)
    often = total / 2**frequent_bits
    hot = np.zeros(1 << SKETCH_BITS, bool)
    hot[np.asarray(counted.where((F.col("kind") == 1) & (F.col("n") >= often)).select("at").toArrow().column("at"), np.int64)] = True
    pairs = docs.select("text").mapInArrow(_frequent_rows(vocabulary, spark.sparkContext.broadcast(hot)), "pair long, n long")
    # At most 2**frequent_bits pairs can reach this count.
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= often).toArrow().sort_by("pair")
    frequent = spark.sparkContext.broadcast((np.asarray(found.column("pair"), np.int64), np.asarray(found.column("n"), np.int64)))

    parts = max(1, math.ceil(total / PAIRS_PER_GROUP))
    packed = docs.mapInArrow(_scored_rows(vocabulary, frequent, parts), PACKED_ROW)
    replies = packed.groupBy("part").applyInArrow(_counted_rows(vocabulary), REPLY_ROW)
    return replies.groupBy("chunk").applyInArrow(_summed_rows, "doc_id long, n_words long, score double")
