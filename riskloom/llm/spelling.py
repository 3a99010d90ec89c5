"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter-count vectors.

A word is the vector of how often each letter occurs in it, with its length as one more axis. Replacing a letter takes one
from an axis and adds one to another, inserting a letter adds one: near words lie at an L1 distance of at most two. A
k-d tree cuts that space into boxes. A coarse tree, whose cuts are fitted on a bounded sample and whose boxes hold every
word, deals the words over the cluster; a fine one is built in each of its cells. A query visits, once for words of its
own length and once for those one longer, the boxes that can hold a vector so near; all others are pruned. The order of
the letters decides last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranking import broadcast_if_small
from riskloom.session import checkpointed, ship

# Fixed by the contract: runs of letters, of at least as many code points; what is changed in them, and when a form is one.
LETTERS, SHORTEST, LEAST_TIMES, ALTERED, FORM_RATIO = r"[A-Za-zÀ-ÿ]", 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SAMPLE = 1 << 16  # words, about, that the cuts of the coarse tree are fitted on
CELL = 1 << 15  # words in a cell of the coarse tree
MOST_CELLS = 1 << 15  # about; beyond that many the cells grow, so that the coarse tree stays small enough for every task
BUCKET = 128  # words in a box of a fine tree
ROOMY = 1 << 22  # pairs or bytes compared at a time

# Every letter is one byte of Latin-1: a-z and U+00C0 to U+00FF are an axis each, the length is the last.
_AXIS = np.zeros(256, np.int64)
_AXIS[0x61:0x7B] = np.arange(26)
_AXIS[0xC0:0x100] = np.arange(26, 90)
LENGTH = 90


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text): see the contract's values above.

    A null text has no words; a null doc_id is written as nothing before the colon. Rows that repeat count again.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"),
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    changed = (F.col("h") % ALTERED) == 0
    words = hashed.where(~changed | (F.col("size") > SHORTEST)).select(F.when(changed, without).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


class Vectors:
    """Words as Latin-1 bytes (`data` from `start`, `size` of them), letter counts up to 255 with the length, and count parities."""

    def __init__(self, words: pa.Array):
        raw = [w.encode("latin-1") for w in words.to_pylist()]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.repeat(np.arange(len(raw)) * LENGTH, self.size) + _AXIS[self.data]
        counts = np.bincount(at, minlength=len(raw) * LENGTH).reshape(-1, LENGTH)
        # Clipping never widens a difference, so pruning by clipped counts loses nothing.
        self.axes = np.minimum(counts, 255).astype(np.uint8)
        # One bit per axis, folded into 64: one letter more or fewer flips one bit.
        bit = np.uint64(1) << (np.arange(LENGTH) % 64).astype(np.uint64)
        self.parity = np.bitwise_xor.reduce(np.where(counts % 2 == 1, bit, np.uint64(0)), axis=1).astype(np.uint64)


@dataclass
class Tree:
    """A k-d tree: each node cuts an axis at a value (up to it left, above it right); `axis` -1 is a box, numbered by `left`."""

    axis: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    boxes: int = 0

    @classmethod
    def over(cls, axes: np.ndarray, size: np.ndarray, most: int) -> Tree:
        """Cut, on the axis that comes closest to halves, until a box has at most `most` vectors or all in it are equal."""
        tree = cls()
        tree._grow(axes, size, np.arange(len(size)), most)
        return tree

    def _grow(self, axes: np.ndarray, size: np.ndarray, rows: np.ndarray, most: int) -> int:
        node = len(self.axis)
        for own in (self.axis, self.cut, self.left, self.right):
            own.append(-1)
        found = self._halves(axes[rows], size[rows]) if len(rows) > most else None
        if found is None:
            self.left[node], self.boxes = self.boxes, self.boxes + 1
            return node
        self.axis[node], self.cut[node] = found
        low = (size[rows] if found[0] == LENGTH else axes[rows, found[0]]) <= found[1]
        self.left[node] = self._grow(axes, size, rows[low], most)
        self.right[node] = self._grow(axes, size, rows[~low], most)
        return node

    @staticmethod
    def _halves(axes: np.ndarray, size: np.ndarray) -> tuple[int, int] | None:
        middle = int(np.median(size))
        tries = [(abs(float((size <= middle).mean()) - 0.5), LENGTH, middle), (abs(float((size < middle).mean()) - 0.5), LENGTH, middle - 1)]
        for cut in range(3):
            share = np.abs((axes <= cut).mean(axis=0) - 0.5)
            best = int(np.argmin(share))
            tries.append((float(share[best]), best, cut))
        off, axis, cut = min(tries)
        if off < 0.5:
            return axis, cut
        spread = axes.max(axis=0) - axes.min(axis=0)
        best = int(np.argmax(spread))
        if spread[best]:
            return best, int(axes[:, best].min()) + int(spread[best] - 1) // 2
        return (LENGTH, int(size.min())) if size.min() < size.max() else None

    def homes(self, axes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The box of each vector."""
        out, open_nodes = np.zeros(len(size), np.int64), [(0, np.arange(len(size)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.axis[node] < 0:
                out[rows] = self.left[node]
            elif len(rows):
                low = (size[rows] if self.axis[node] == LENGTH else axes[rows, self.axis[node]]) <= self.cut[node]
                open_nodes += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def reach(self, axes: np.ndarray, size: np.ndarray, longer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(box, rows) of the vectors that may have a near one in it: of their length, or one `longer`.

        A vector may move up one axis and, for its own length, down another one; each move is made at most once on the
        way to a box, where the vector would otherwise be on the other side of a cut.
        """
        none = np.full(len(size), -1, np.int16)
        open_nodes = [(0, np.arange(len(size)), none, none)]
        while open_nodes:
            node, rows, up, down = open_nodes.pop()
            if not len(rows):
                continue
            axis, cut = self.axis[node], self.cut[node]
            if axis < 0:
                yield self.left[node], rows
                continue
            if axis == LENGTH:
                low = size[rows] + longer <= cut
                open_nodes += [(self.left[node], rows[low], up[low], down[low]), (self.right[node], rows[~low], up[~low], down[~low])]
                continue
            x = axes[rows, axis].astype(np.int16) + (up == axis) - (down == axis)
            low = x <= cut
            rises = np.flatnonzero((x == cut) & (up < 0) & (down != axis))
            falls = np.flatnonzero((x == cut + 1) & (down < 0) & (up != axis)) if not longer else rises[:0]
            moved = np.full(max(len(rises), len(falls)), axis, np.int16)
            stay, over = np.flatnonzero(low), np.flatnonzero(~low)
            for child, own, crossing, ups, downs in (
                (self.left[node], stay, falls, up[falls], moved[: len(falls)]),
                (self.right[node], over, rises, moved[: len(rises)], down[rises]),
            ):
                both = np.concatenate([own, crossing])
                open_nodes.append((child, rows[both], np.concatenate([up[own], ups]), np.concatenate([down[own], downs])))


def near_in_order(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray, longer: bool) -> np.ndarray:
    """Whether word i of `a` becomes word j of `b` by replacing a letter, or by inserting one where b is `longer`."""
    out = np.zeros(len(i), bool)
    order = np.argsort(a.size[i], kind="stable")
    sizes = a.size[i[order]]
    for size in np.unique(sizes).tolist():
        group = order[np.searchsorted(sizes, size) : np.searchsorted(sizes, size, "right")]
        for part in np.array_split(group, len(group) * size // ROOMY + 1):
            x = a.data[a.start[i[part]][:, None] + np.arange(size)]
            y = b.data[b.start[j[part]][:, None] + np.arange(size + longer)]
            if longer:
                ahead = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
                behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                out[part] = ahead + behind >= size
            else:
                out[part] = (x != y).sum(axis=1) == 1
    return out


class Cell:
    """The words of one cell (sorted) under a fine tree."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.words, self.n = words, n
        self.vectors = Vectors(words)
        self.tree = Tree.over(self.vectors.axes, self.vectors.size, BUCKET)
        home = self.tree.homes(self.vectors.axes, self.vectors.size)
        self.order = np.argsort(home, kind="stable")
        self.first = np.searchsorted(home[self.order], np.arange(self.tree.boxes + 1))

    def links(self, queries: Vectors, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of near words: in the queries, in the cell."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own, distance = self.vectors, 1 if longer else 2
        for box, rows in self.tree.reach(queries.axes, queries.size, longer):
            members = self.order[self.first[box] : self.first[box + 1]]
            for part in np.array_split(rows, len(rows) * len(members) // ROOMY + 1):
                close = np.bitwise_count(queries.parity[part][:, None] ^ own.parity[members]) <= distance
                close &= queries.size[part][:, None] + longer == own.size[members]
                i, j = np.nonzero(close)
                i, j = part[i], members[j]
                near = np.concatenate(
                    [np.zeros(0, bool)]
                    + [np.abs(queries.axes[i[k : k + 40_000]].astype(np.int16) - own.axes[j[k : k + 40_000]]).sum(axis=1) <= distance for k in range(0, len(i), 40_000)]
                )
                left.append(i[near])
                right.append(j[near])
        i, j = np.concatenate(left), np.concatenate(right)
        real = near_in_order(queries, i, own, j, longer)
        return i[real], j[real]


def _best(of: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place in `of`: how many others, and the one of largest n, the first of equals (words are sorted)."""
    order = np.lexsort((other, -n[other], of))
    places, first, times = np.unique(of[order], return_index=True, return_counts=True)
    return places, times, other[order][first]


def _search_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, role, word, n), sorted, to (word, n_near, near, near_n), a part of what is near to a word."""
    here, members, cell = None, [], None

    def found(words: pa.Array, n: np.ndarray, longer: bool) -> Iterator[pa.RecordBatch]:
        i, j = cell.links(Vectors(words), longer)
        sides = [(words, i, cell.words, j, cell.n)]
        if longer:  # the longer words learn of the shorter ones here; words of one length ask for themselves
            sides.append((cell.words, j, words, i, n))
        for own, at, others, other, weight in sides:
            if len(at):
                places, times, best = _best(at, other, weight)
                columns = [own.take(pa.array(places)), pa.array(times.astype(np.int64)), others.take(pa.array(best)), pa.array(weight[best])]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near", "near_n"])

    for batch in batches:
        home, role = np.asarray(batch.column("home")), np.asarray(batch.column("role"))
        n = np.asarray(batch.column("n"))
        turns = np.flatnonzero(np.diff(home) | np.diff(role)) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(home)]):
            if a == b:
                continue
            if home[a] != here:
                here, members, cell = home[a], [], None
            words = batch.column("word").slice(a, b - a)
            if role[a] == 0:
                members.append((words, n[a:b]))
            elif members:
                if cell is None:
                    cell = Cell(pa.concat_arrays([w for w, _ in members]), np.concatenate([k for _, k in members]))
                yield from found(words, n[a:b], bool(role[a] == 2))


def _home_rows(tree: Tree, most: int):
    """(home) of each word: its cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Vectors(batch.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(tree.homes(v.axes, v.size))], ["home"])

    return rows


PARTS = 20  # bits for the part of a cell


def _dealt_rows(tree: Tree, parts: dict[int, int]):
    """Each word as a member of its cell (one part of it), and as a query in every cell that may hold a near word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.ones(tree.boxes, np.int64)
        for box, many in parts.items():
            count[box] = many
        for batch in batches:
            v = Vectors(batch.column("word"))
            spread = np.asarray(batch.column("spread"))
            home = tree.homes(v.axes, v.size)
            places = [(home << PARTS) + spread % count[home]]
            who, role = [np.arange(len(home))], [np.zeros(len(home), np.int8)]
            for longer in (False, True):
                for box, of in tree.reach(v.axes, v.size, longer):
                    many = int(count[box])
                    who.append(np.repeat(of, many))
                    places.append((box << PARTS) + np.tile(np.arange(many), len(of)))
                    role.append(np.full(many * len(of), 1 + longer, np.int8))
            at = pa.array(np.concatenate(who))
            columns = [pa.array(np.concatenate(places)), pa.array(np.concatenate(role)), batch.column("word").take(at), batch.column("n").take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["home", "role", "word", "n"])

    return rows


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, near_n, near) of the words of `words` (word, n; distinct) that have near words; `near` is the one of largest n.

    The cuts are fitted on about `sample` words; every word is in a cell and every cell in reach is searched, so no near
    word is missed whatever the cuts. A cell that turns out larger, as by very many anagrams, is dealt into parts by a
    hash, and its queries go to each of them.
    """
    total = words.count()
    most = max(cell, total // MOST_CELLS)
    step = max(1, total // sample)
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select("word").toArrow().column("word").combine_chunks()
    v = Vectors(chosen)
    tree = Tree.over(v.axes, v.size, max(1, most // step))
    sizes = words.select("word").mapInArrow(_home_rows(tree, most), "home long").groupBy("home").agg(F.count(F.lit(1)).alias("m"))
    parts = {r["home"]: -(-r["m"] // most) for r in sizes.where(F.col("m") > 2 * most).toLocalIterator()}
    spread = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << PARTS)).alias("spread")
    dealt = words.select("word", "n", spread).mapInArrow(_dealt_rows(tree, parts), "home long, role byte, word string, n long")
    dealt = dealt.repartition("home").sortWithinPartitions("home", "role", "word")
    found = dealt.mapInArrow(_search_rows, "word string, n_near long, near string, near_n long")
    first = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.k")).alias("near_n"), "b.near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form: the last one on the way. A form is ten times as frequent, so ways are short."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        # Stored, so that the join shuffles both sides itself and adaptive execution can split a form that very many words have.
        at = checkpointed(at)
        further = at.select(F.col("word").alias("_via"), F.col("root").alias("_root"))
        joined = at.join(broadcast_if_small(further), F.col("root") == F.col("_via"), "left")
        if joined.where("_root is not null").isEmpty():
            return at
        at = joined.select("word", F.coalesce("_root", "root").alias("root"))


def spelling_variants(docs: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """One row per word of `docs` (doc_id, text): word, n, n_near, form, form_n, root.

    Of near words of equal n the first in code-point order is the form. Null and empty texts have no words, repeated
    rows count again, further columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    words = checkpointed(word_counts(docs))
    near = near_words(words, cell, sample)
    real: Column = F.col("near_n") >= FORM_RATIO * F.col("n")
    each = checkpointed(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("near")).alias("form"), F.when(real, F.col("near_n")).alias("form_n")
        )
    )
    roots = _roots(each.where("form is not null"))
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
