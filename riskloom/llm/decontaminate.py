"""Benchmark decontamination: Wu-Manber search for many test strings, over words instead of letters.

Patterns are windows of consecutive words of benchmark items. For each pattern length a shift table, indexed by a hash
of two neighbouring words, says how far the search may jump; where it may not, the last words' hash selects a bucket
of patterns, and the words themselves are compared. All segments of a batch are searched in step, so that the jumps
stay array operations.

Tasks deal the items into blocks of a checked size and build each block's tables. One block is broadcast. A benchmark
of several is searched in as many passes over the texts, each with one block; passes write what they hit, which is
little, and the texts never move.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import Words, mixed, pieces, small_batches, with_columns
from riskloom.operators.ranking import broadcast_if_small
from riskloom.session import run_folder

WINDOW = 10  # words of a window; an item of fewer is one window
TABLE_BITS = 18  # entries of a shift table
BLOCK_WORDS = 1 << 20  # words of the items of one block at most; longer items are cut, windows stay whole
SEGMENT = 64  # positions that one cursor covers


@dataclass
class Length:
    """Patterns of one number of words: rows of `words`, sorted by `bucket` (hash of the last two words), and the shifts."""

    size: int
    words: np.ndarray
    bucket: np.ndarray
    window: np.ndarray
    shift: np.ndarray


@dataclass
class Block:
    """Patterns of some items; `owners` lists for each distinct window the items that have it."""

    lengths: list[Length]
    owner_first: np.ndarray
    owners: np.ndarray
    names: list[str]
    spelling: dict[int, bytes]


def _pair(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Hash of the two words that end at `at`; of one where patterns have but one."""
    if size == 1:
        return hashes[at]
    return mixed(hashes[at - 1] * np.uint64(0x9FB21C651E98DF25) ^ hashes[at], 90)


def build(items: list[tuple[str, str]]) -> Block:
    """The tables for items given as (name, text)."""
    words = Words(pa.array([t for _, t in items], pa.string()))
    names = sorted({n for n, _ in items})
    number = {n: k for k, n in enumerate(names)}
    raw = words.data.tobytes()
    spelling = {int(h): raw[b:e] for h, b, e in zip(words.hash.tolist(), words.begin.tolist(), words.end.tolist())}
    by_size: dict[int, tuple[list[np.ndarray], list[int]]] = {}
    for k, (name, _) in enumerate(items):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if a < b:
            size = min(WINDOW, b - a)
            rows, owner = by_size.setdefault(size, ([], []))
            own = np.lib.stride_tricks.sliding_window_view(words.hash[a:b], size)
            rows.append(own)
            owner += [number[name]] * len(own)
    lengths, first, owners, windows = [], [0], [], 0
    for size, (rows, owner) in sorted(by_size.items()):
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array(owner)], axis=1), axis=0)
        counts = np.bincount(pairs[:, 0], minlength=len(distinct))
        owners.append(pairs[:, 1])
        first += (first[-1] + np.cumsum(counts)).tolist()
        block = min(2, size)
        shift = np.full(1 << TABLE_BITS, size - block + 1, np.int64)
        for end in range(block - 1, size):
            flat = distinct[:, end - block + 1 : end + 1].ravel()
            at = np.arange(block - 1, len(flat), block)
            np.minimum.at(shift, (_pair(flat, size, at) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), size - 1 - end)
        last = distinct[:, -block:].ravel()
        bucket = _pair(last, size, np.arange(block - 1, len(last), block))
        order = np.argsort(bucket, kind="stable")
        lengths.append(Length(size, distinct[order], bucket[order], order + windows, shift))
        windows += len(distinct)
    return Block(lengths, np.array(first), np.concatenate(owners) if owners else np.zeros(0, np.int64), names, spelling)


def _item_pieces(most: int):
    """Items, those of more than `most` words in pieces that overlap so far that every window lies in one of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                names, texts, sizes = [], [], []
                words = Words(batch.column("text"))
                raw = words.data.tobytes()
                for name, a, b in zip(batch.column("name").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                    for lo in range(a, max(a + 1, b - WINDOW + 1), most - WINDOW + 1):
                        hi = min(lo + most, b)
                        if lo < hi:
                            names.append(name)
                            texts.append(raw[words.begin[lo] : words.end[hi - 1]].decode())
                            sizes.append(hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["name", "text", "words"])

    return rows


def _table_rows(group: pa.Table) -> pa.Table:
    items = list(zip(group.column("name").to_pylist(), group.column("text").to_pylist()))
    return pa.table({"block": group.column("block")[:1], "tables": pa.array([pickle.dumps(build(items), 5)], pa.binary())})


def blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(block, tables), stored, and the number of blocks: items dealt by hash, more thinly until no block is too large.

    Item ids are compared as strings; the tables are built by tasks, a block each.
    """
    spark = benchmark.sparkSession
    small_batches(spark)
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name")
    folder, n = run_folder(spark, "benchmark"), 1
    items = benchmark.select(name, F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    items.mapInArrow(_item_pieces(max(2 * WINDOW, BLOCK_WORDS // 8)), "name string, text string, words long").write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    known = items.count()
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum("words").alias("words")).agg(F.max("words")).first()[0] or 0
        if most <= BLOCK_WORDS or n > 4 * known:
            break
        n *= 2
    dealt.select("block", "name", "text").groupBy("block").applyInArrow(_table_rows, "block long, tables binary").write.parquet(f"{folder}/tables")
    return spark.read.parquet(f"{folder}/tables"), n


def occurrences(words: Words, patterns: Length) -> tuple[np.ndarray, np.ndarray]:
    """Where patterns end, as (position of the last word, row of `patterns.words`), by word hashes.

    A cursor stands at the last word of a possible occurrence and jumps by
    the shift of the two words there.
    """
    size, none = patterns.size, np.zeros(0, np.int64)
    if len(words.hash) < size or not len(patterns.words):
        return none, none
    # A cursor for each segment of each text, beginning at the first word that can end a pattern.
    firsts, ends = words.first[:-1] + size - 1, words.first[1:]
    room = np.maximum(0, ends - firsts)
    per_text = -(-room // SEGMENT)
    owner = np.repeat(np.arange(len(room)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    cursor = firsts[owner] + nth * SEGMENT
    stop = np.minimum(cursor + SEGMENT, ends[owner])
    ended_at, rows = [], []
    while len(cursor):
        pair = _pair(words.hash, size, cursor)
        shift = patterns.shift[(pair >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        stuck = shift == 0
        if stuck.any():
            at, key = cursor[stuck], pair[stuck]
            lo = np.searchsorted(patterns.bucket, key, side="left")
            n = np.searchsorted(patterns.bucket, key, side="right") - lo
            place = np.repeat(at, n)
            row = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            for k in range(size):  # direct comparison, word by word, of what is still equal
                same = words.hash[place - size + 1 + k] == patterns.words[row, k]
                place, row = place[same], row[same]
            ended_at.append(place)
            rows.append(row)
        cursor = cursor + np.maximum(shift, 1)
        going = cursor < stop
        cursor, stop = cursor[going], stop[going]
    return (np.concatenate(ended_at), np.concatenate(rows)) if ended_at else (none, none)


def _confirmed(words: Words, block: Block, position: np.ndarray) -> np.ndarray:
    """Which words, whose hashes occur in the block, are spelt as there."""
    raw = words.data
    good = np.empty(len(position), bool)
    for i, (h, b, e) in enumerate(zip(words.hash[position].tolist(), words.begin[position].tolist(), words.end[position].tolist())):
        good[i] = raw[b:e].tobytes() == block.spelling.get(h)
    return good


def hits(words: Words, block: Block) -> tuple[np.ndarray, list[set[str]]]:
    """Which words lie in an occurrence of a pattern, and for each text the names of the items found in it."""
    n = len(words.first) - 1
    text_of = np.repeat(np.arange(n), np.diff(words.first))
    hit = np.zeros(len(words.hash), bool)
    found: list[set[str]] = [set() for _ in range(n)]
    for patterns in block.lengths:
        at, row = occurrences(words, patterns)
        if not len(at):
            continue
        mark = np.zeros(len(hit) + 1, np.int32)
        np.add.at(mark, at - patterns.size + 1, 1)
        np.add.at(mark, at + 1, -1)
        position = np.flatnonzero(np.cumsum(mark[:-1]))
        spelt = np.zeros(len(hit), bool)
        spelt[position] = _confirmed(words, block, position)
        if not spelt[position].all():
            good = np.array([spelt[e - patterns.size + 1 : e + 1].all() for e in at.tolist()], bool)
            at, row = at[good], row[good]
            mark[:] = 0
            np.add.at(mark, at - patterns.size + 1, 1)
            np.add.at(mark, at + 1, -1)
            position = np.flatnonzero(np.cumsum(mark[:-1]))
        hit[position] = True
        window = patterns.window[row]
        pairs = np.unique(np.stack([text_of[at], window], axis=1), axis=0)
        for t, w in pairs.tolist():
            found[t].update(block.names[o] for o in block.owners[block.owner_first[w] : block.owner_first[w + 1]].tolist())
    return hit, found


def search(column: pa.Array, block: Block) -> list[tuple[int, int, list[str]]]:
    """For each text the number of its words, of words hit, and the names of the items found in it."""
    words = Words(column)
    hit, found = hits(words, block)
    upto = np.append(0, np.cumsum(hit))
    return [(b - a, int(upto[b] - upto[a]), sorted(names)) for a, b, names in zip(words.first[:-1].tolist(), words.first[1:].tolist(), found)]


HITS = "digest string, spans array<struct<lo: int, hi: int>>, items array<string>"


def _pass_rows(table):
    """Texts to those that a block hits: a digest of the text, its runs of words hit, and the items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(table.value)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                words = Words(batch.column("text"))
                hit, found = hits(words, block)
                digests, spans, items = [], [], []
                for k in [k for k, names in enumerate(found) if names]:
                    own = np.concatenate([[0], hit[words.first[k] : words.first[k + 1]].view(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(own)).tolist()
                    digests.append(hashlib.sha256(batch.column("text")[k].as_py().encode()).hexdigest())
                    spans.append([{"lo": lo, "hi": hi} for lo, hi in zip(edges[::2], edges[1::2])])
                    items.append(sorted(found[k]))
                kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["digest", "spans", "items"])

    return rows


def _in_passes(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """`with_hits` for a benchmark of several blocks. What a pass finds depends on the text alone, so it is kept by text."""
    spark = docs.sparkSession
    folder = run_folder(spark, "benchmark-hits")
    numbers = [row["block"] for row in tables.select("block").orderBy("block").collect()]
    for number in numbers:
        table = spark.sparkContext.broadcast(bytes(tables.where(F.col("block") == number).first()["tables"]))
        docs.where("text is not null").select("text").mapInArrow(_pass_rows(table), HITS).write.parquet(f"{folder}/block={number}")
        table.destroy()
    found = spark.read.schema(HITS + ", block long").option("basePath", folder).parquet(*(f"{folder}/block={number}" for number in numbers))
    once = found.groupBy("digest", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    merged = once.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda seen, span: F.struct(
            (seen["n"] + F.greatest(F.lit(0), span["hi"] - F.greatest(span["lo"], seen["upto"]))).alias("n"), F.greatest(span["hi"], seen["upto"]).alias("upto")
        ),
    )["n"]
    merged = merged.select("digest", counted.cast("long").alias("n_hit"), "items")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.sha2("text", 256).alias("digest"))
    joined = held.join(broadcast_if_small(merged), "digest", "left")
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("_n_words", "_n_hit", "_items")]
    # Fixed: what is not in [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
    words = F.regexp_count(F.coalesce(F.col("doc")["text"], F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]++")).cast("long")
    none = F.array().cast("array<string>")
    return joined.select(*own, words.alias("_n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("items", none).alias("_items"))


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with `_n_words`, `_n_hit` and `_items` (ids of items found in the text, sorted as strings).

    Null text has no words. An item without words has no window; an item without an id counts under the name null;
    repeated items count once. Without items nothing is hit. Other columns pass through; of the names of the new ones
    the old ones go.
    """
    tables, n = blocks(benchmark)
    if n > 1:
        return _in_passes(docs, tables)
    stored = tables.first()
    held = docs.sparkSession.sparkContext.broadcast(bytes(stored["tables"]) if stored else pickle.dumps(build([])))

    def compute():
        block = pickle.loads(held.value)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            out = search(batch.column("text"), block)
            return [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))]

        return columns

    return with_columns(docs, [("_n_words", "long"), ("_n_hit", "long"), ("_items", "array<string>")], compute)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: counts, a digest of the items found, and whether any word is hit."""
    return with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )
