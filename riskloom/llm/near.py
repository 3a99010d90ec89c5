"""Near-duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is its bag of five-word shingles, weighted by how often each occurs times its inverse document frequency. The
samples (Ioffe's improved scheme) of two bags agree with a probability equal to their weighted Jaccard similarity.
Texts with the same bag are one node. Nodes that share a band of samples are candidates. They are compared with a few
chiefs of the band first, which links groups of edited copies at the cost of one pair a member. What is still mixed then
is finished exactly: small bands pair by pair, members of larger ones by a join on the rarest shingles of each text,
which meets every similar pair that is left. Each pair is verified on its whole texts, and classes are the connected
components of verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.text import Words, mixed, pieces, shingle_hashes, small_batches
from riskloom.session import run_folder

SHINGLE, SIMILAR = 5, 0.8
BANDS, BAND_SAMPLES = 16, 4  # a pair of similarity 0.8 shares a band with probability 0.9998, one of 0.2 with 0.025
SKETCH_BITS = 17  # document frequencies are counted in 2**17 cells, whatever the corpus
DAMPING = 0.25  # weight of the frequency term: the rarest shingle weighs 1.25, one that is everywhere 1
CHIEFS = 4  # of a band in the second step
SMALL = 8  # members of a band up to which they are compared pair by pair
SLACK = 1e-6  # of a similarity, for rounding in sums of weights
WEIGHT_STEP = 1.03  # texts are joined by ranges of their weight, each wider by this factor than the one below
FILTER_BITS = 26  # bits of the filter that says which texts a verification may need: 8 MB
PIECE = 1 << 18  # bytes of text sampled at a time

_steps = np.linspace(0, 60, 1 << 20)
_GAMMA = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + _steps) * np.exp(-_steps), _steps).astype(np.float32)
_LOG_GAMMA, _INVERSE_GAMMA = np.log(_GAMMA), 1 / _GAMMA
_ODD = mixed(np.arange(BANDS * BAND_SAMPLES, dtype=np.uint64), 31) | np.uint64(1)


class Bags:
    """Distinct shingles (`hash`, sorted within a text), their `count`, and the `first` of each text."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        ends, n = words.first, len(words.first) - 1
        length = np.diff(ends)
        long = length >= SHINGLE
        size = np.where(long, length - SHINGLE + 1, np.minimum(length, 1))
        at = np.concatenate([[0], np.cumsum(size)])
        every = np.empty(at[-1], np.uint64)
        if long.any():
            rolled = shingle_hashes(words.hash, SHINGLE)  # at every word; those that reach into the next text go
            text_of = np.repeat(np.arange(n), length)
            reach = np.arange(len(words.hash)) + SHINGLE <= ends[1:][text_of]
            every[np.repeat(long, size)] = rolled[np.flatnonzero(reach[: len(rolled)])]
        for i in np.flatnonzero((length > 0) & ~long).tolist():
            every[at[i]] = shingle_hashes(words.hash[ends[i] : ends[i + 1]], SHINGLE)[0]
        bounds = at.tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            every[a:b].sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        new[at[:-1][size > 0]] = True
        heads = np.flatnonzero(new)
        self.hash = every[heads]
        self.count = np.diff(np.append(heads, len(every)))
        self.first = np.searchsorted(heads, at)
        self.filled = size > 0

    def keys(self) -> list[bytes | None]:
        """A 128-bit hash of each bag; None for a text without words."""
        out: list[bytes | None] = [None] * len(self.filled)
        if len(self.hash):
            heads = self.first[:-1][self.filled]
            parts = [np.add.reduceat(mixed(self.hash ^ mixed(self.count.astype(np.uint64), 60 + k), 50 + k), heads) for k in (0, 1)]
            raw = np.stack(parts, axis=1).astype(">u8").tobytes()
            for j, i in enumerate(np.flatnonzero(self.filled).tolist()):
                out[i] = raw[16 * j : 16 * j + 16]
        return out

    def weights(self, inverse: np.ndarray) -> np.ndarray:
        return self.count * inverse[(self.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per cell of one task; the cell past the last counts the documents."""
    cells = np.zeros((1 << SKETCH_BITS) + 1, np.int64)
    for whole in batches:
        for batch in pieces(whole, "text", PIECE):
            bags = Bags(batch.column("text"))
            cells += np.bincount((bags.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
            cells[-1] += np.count_nonzero(bags.filled)
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["at", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The damped inverse document frequency of each cell, from all documents; 2**SKETCH_BITS numbers.

    A cell holds many rare shingles beside at most a few frequent ones, so what the typical cell has is taken off.
    """
    rows = docs.select("text").mapInArrow(_sketch_rows, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros((1 << SKETCH_BITS) + 1)
    cells[np.asarray(rows.column("at"))] = np.asarray(rows.column("n"))
    total, cells = cells[-1], cells[:-1]
    frequency = np.clip(cells - np.median(cells), 1, max(total, 1))
    return 1 + DAMPING * np.log((total + 1) / frequency) / np.log(total + 2)


def samples(bags: Bags, weights: np.ndarray) -> np.ndarray:
    """For each text with words BANDS x BAND_SAMPLES fingerprints of sampled (shingle, level) pairs."""
    heads = bags.first[:-1][bags.filled]
    out = np.empty((len(_ODD), len(heads)), np.uint32)
    log_weight = np.log(weights).astype(np.float32)
    for k, odd in enumerate(_ODD):
        u = bags.hash * odd
        u ^= u >> np.uint64(32)
        u *= np.uint64(0x94D049BB133111EB)
        high = (u >> np.uint64(32)).astype(np.uint32)
        i = (u & np.uint64(0xFFFF)).astype(np.int64)
        j = ((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
        beta = high.astype(np.float32) * np.float32(2**-32)
        level = np.floor(log_weight * _INVERSE_GAMMA[i] + beta)
        a = _LOG_GAMMA[j] - _GAMMA[i] * (level - beta + np.float32(1))
        bits = a.view(np.uint32)
        order = bits ^ ((a.view(np.int32) >> 31).view(np.uint32) | np.uint32(0x80000000))
        mark = high ^ (level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        both = (order.astype(np.uint64) << np.uint64(32)) | mark
        out[k] = np.minimum.reduceat(both, heads).astype(np.uint32)
    return out


def _signature_rows(inverse):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                bags = Bags(batch.column("text"))
                ends = np.concatenate([[0], np.cumsum(np.where(bags.filled, BANDS, 0))]).astype(np.int32)
                if len(bags.hash):
                    marks = samples(bags, bags.weights(inverse.value)).reshape(BANDS, BAND_SAMPLES, -1).astype(np.uint64)
                    value = np.zeros((BANDS, marks.shape[2]), np.uint64)
                    for j in range(BAND_SAMPLES):
                        value = mixed(value ^ marks[:, j], 70)
                    value ^= mixed(np.arange(BANDS, dtype=np.uint64), 71)[:, None]
                    flat = value.T.ravel().view(np.int64)
                else:
                    flat = np.zeros(0, np.int64)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                columns = [batch.column("doc_id"), batch.column("row_md5"), pa.array(bags.keys(), pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_md5", "key", "bands"])

    return signatures


def _text_rows(wanted):
    """(key, text) of texts whose key passes the filter, once per task."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                keys = Bags(batch.column("text")).keys()
                rows = []
                for i, key in enumerate(keys):
                    if key is None or key in sent:
                        continue
                    at = int.from_bytes(key[:8], "big") >> (64 - FILTER_BITS)
                    if wanted.value[at >> 3] >> (at & 7) & 1:
                        sent.add(key)
                        rows.append(i)
                text = batch.column("text").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], pa.binary()), text], ["key", "text"])

    return texts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags given as (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _verified_rows(inverse):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chief_key, chief = None, None
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                bags = Bags(batch.column("text"))
                weights = bags.weights(inverse.value)
                chiefs, good = batch.column("chief").to_pylist(), []
                for i, key in enumerate(chiefs):
                    if key != chief_key:
                        other = Bags(batch.column("chief_text").slice(i, 1))
                        chief_key, chief = key, (other.hash, other.weights(inverse.value))
                    own = slice(int(bags.first[i]), int(bags.first[i + 1]))
                    if similarity((bags.hash[own], weights[own]), chief) >= SIMILAR:
                        good.append(i)
                rows = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("class").take(rows), batch.column("chief_class").take(rows)], ["a", "b"])

    return verified


def _shingle_rows(inverse):
    """(shingle, key, class, own) for each distinct shingle of a text: its weight there."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                bags = Bags(batch.column("text"))
                owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bags.first)))
                columns = [pa.array(bags.hash.view(np.int64)), batch.column("key").take(owner), batch.column("class").take(owner), pa.array(bags.weights(inverse.value))]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "key", "class", "own"])

    return shingles


SHARE = (SIMILAR - SLACK) / (1 + SIMILAR)  # what two similar texts have in common, of the sum of their weights


def _prefixes(members: DataFrame, inverse) -> DataFrame:
    """The shingles of the prefix of each of `members` (key, class, text) that other classes have too: shingle, key, class, weight, rest.

    A text's shingles are put in order, those that fewest members have first; `rest` is the weight from a shingle on. All
    that two texts have in common lies from the first shingle on that both have. So that one comes, in either text, before
    less is left than the common weight has to be: at least SIMILAR of the heavier text.
    """
    shingles = _stored(members.mapInArrow(_shingle_rows(inverse), "shingle long, key binary, class binary, own double"))
    held = F.xxhash64("class")
    counted = _stored(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), (F.min(held) != F.max(held)).alias("met")))
    back = Window.partitionBy("key").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    placed = shingles.join(counted, "shingle").select(
        "shingle", "key", "class", "met",
        F.sum("own").over(Window.partitionBy("key")).alias("weight"),
        F.sum("own").over(back).alias("rest"),
    )
    return placed.where(F.col("met") & (F.col("rest") >= (SIMILAR - SLACK) * F.col("weight"))).drop("met")


def _prefix_pairs(members: DataFrame, inverse) -> DataFrame:
    """Pairs of `members` of different classes, among them every one that is similar, with how many prefix shingles they share.

    The lighter of two similar texts has a common shingle with at least 2 * SHARE of it left, the heavier one with at
    least SIMILAR left; both allow the other one a weight that follows from what is left. So texts that share a passage,
    but too little to be similar, do not meet, as long as each has enough else. Texts of one class are not paired either:
    classes that meet are found before their members.
    """
    entries = _stored(_prefixes(members, inverse))
    size = lambda w: F.floor(F.log(w) / np.log(WEIGHT_STEP)).cast("int")
    most = F.col("rest") / SHARE - F.col("weight")  # the weight that the other text may have
    light = entries.where(most >= F.col("weight") * (1 - SLACK)).withColumn("size", size(F.col("weight"))).withColumn("most", most)
    heavy = entries.withColumn("most", F.least(most, F.col("weight")) * (1 + SLACK)).withColumn("least", F.col("weight") * (SIMILAR - SLACK))
    heavy = heavy.where("most >= least").withColumn("size", F.explode(F.sequence(size(F.col("least")), size(F.col("most")))))
    light, heavy = _stored(light), _stored(heavy)
    at = ["shingle", "size"]
    classes = heavy.groupBy(*at, "class").agg(F.max("weight").alias("heaviest"))
    others = light.groupBy(*at, F.col("class").alias("chief_class")).agg(F.max("most").alias("allowed"), F.min("weight").alias("lightest"))
    met = _stored(classes.join(others, at).where((F.col("class") != F.col("chief_class")) & (F.col("heaviest") >= F.col("lightest") * (1 - SLACK))).select(*at, "class", "chief_class"))
    one = heavy.select(*at, "class", "key", "weight", "least", F.col("most").alias("allowed"))
    two = light.select(*at, F.col("class").alias("chief_class"), F.col("key").alias("chief"), F.col("weight").alias("chief_weight"), F.col("most").alias("chief_allowed"))
    pairs = one.join(met, [*at, "class"]).join(two, [*at, "chief_class"])
    could = F.col("chief_weight").between(F.col("least"), F.col("allowed")) & (F.col("weight") <= F.col("chief_allowed") * (1 + SLACK))
    return pairs.where(could).groupBy("key", "chief", "class", "chief_class").agg(F.count(F.lit(1)).alias("shared"))


def _key_bit(key: Column) -> Column:
    """The place of a key in the filter: its first FILTER_BITS bits."""
    return F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS)


def _filter(keys: DataFrame) -> bytes:
    """A bitmap of 2**FILTER_BITS bits with those of the keys set; where it is full it filters less, and loses none."""
    bits = keys.select(_key_bit(F.col("key")).alias("bit"))
    parts = bits.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("map"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["map"]
    return bytes(out)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b) that is not its own root: the least node of its component is the root.

    Large-star and small-star steps; each is a grouped minimum, combined before the shuffle, and a join.
    """
    edges = _stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Done when every node is either a root or has one edge, to its root.
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))))
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if each.where("up > 1 or up = 1 and root = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = _stored(
            small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        )


def _stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut, and joins shuffle both sides, so that hot keys can be split."""
    folder = run_folder(df.sparkSession, "near")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _mixed(placed: DataFrame) -> DataFrame:
    """Bands where classes still meet; merging classes never mixes a band again."""
    hashed = F.xxhash64("class")
    bands = placed.groupBy("band").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high"))
    return bands.where("low <> high").select("band")


def _sized(keyed: DataFrame) -> DataFrame:
    return keyed.join(_stored(keyed.groupBy("class").agg(F.count(F.lit(1)).alias("size"))), "class")


def _with_chiefs(placed: DataFrame, step: int) -> DataFrame:
    """Members of a band, each with the band's chiefs that are of other classes, no smaller than its own.

    A chief is the member that shares the most band places with others, which in a group of edited copies is one with
    few edits: of the whole band first, of each of CHIEFS parts of it next.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(CHIEFS)) if step else F.lit(0)
    first = F.max(F.struct(F.col("central").alias("r"), F.col("key").alias("chief"), F.col("class").alias("chief_class"), F.col("size").alias("chief_size")))
    # Stored, so that the join shuffles both sides itself and adaptive execution can split a hot band.
    chiefs = _stored(placed.groupBy("band", part.alias("part")).agg(first.alias("c")).select("band", "c.chief", "c.chief_class", "c.chief_size"))
    pairs = placed.join(chiefs, "band").where("class <> chief_class and size <= chief_size")
    return pairs.select("key", "chief", "class", "chief_class")


def _small_pairs(placed: DataFrame) -> DataFrame:
    """All pairs of different classes in bands of at most SMALL members."""
    small = placed.where(F.col("n") <= SMALL).select("band", "key", "class")
    other = small.select("band", F.col("key").alias("chief"), F.col("class").alias("chief_class"))
    return small.join(other, "band").where("class <> chief_class and key < chief").groupBy("key", "chief", "class", "chief_class").agg(F.count(F.lit(1)).alias("shared"))


class _Classes:
    """Classes of the nodes while links are found: `keyed` (key, central, class, size) and `placed`, their places in bands that are still mixed."""

    def __init__(self, bands: DataFrame, texts: DataFrame, inverse):
        self.texts, self.inverse, self.bands = texts, inverse, bands
        central = bands.groupBy("key").agg(F.sum("n").alias("central"))
        self.keyed = _stored(central.withColumn("class", F.col("key")).withColumn("size", F.lit(1).cast("long")))
        self.placed = _stored(bands.join(self.keyed, "key"))

    def verify(self, pairs: DataFrame) -> None:
        """Merges the classes of those of `pairs` (key, chief, class, chief_class) that are similar."""
        full = pairs.join(self.texts, "key").join(self.texts.select(F.col("key").alias("chief"), F.col("text").alias("chief_text")), "chief")
        links = full.select("class", "chief_class", "chief", "text", "chief_text").mapInArrow(_verified_rows(self.inverse), "a binary, b binary")
        links = _stored(links.distinct())
        if links.isEmpty():
            return
        roots = components(links).withColumnRenamed("node", "class")
        self.keyed = _stored(_sized(self.keyed.join(roots, "class", "left").select("key", "central", F.coalesce("root", "class").alias("class"))))
        moved = _stored(self.placed.select("key", "band", "n").join(self.keyed, "key"))
        self.placed = _stored(moved.join(_stored(_mixed(moved)), "band"))

    def current(self, pairs: DataFrame) -> DataFrame:
        """`pairs` with the classes of now, without those that are in one by now."""
        now = self.keyed.select("key", "class")
        there = now.select(F.col("key").alias("chief"), F.col("class").alias("chief_class"))
        return pairs.select("key", "chief", "shared").join(now, "key").join(there, "chief").where("class <> chief_class")

    def finish(self) -> None:
        """Verifies all that may still be similar: first the likeliest pair of each two classes, then what that leaves apart."""
        members = self.placed.where(F.col("n") > SMALL).select("key", "class").distinct()
        pairs = _stored(_prefix_pairs(members.join(self.texts, "key"), self.inverse).unionByName(_small_pairs(self.placed)))
        best = F.max(F.struct("shared", "key", "chief"))
        two = [F.least("class", "chief_class").alias("x"), F.greatest("class", "chief_class").alias("y")]
        first = _stored(pairs.groupBy(*two).agg(best.alias("b")).select("b.key", "b.chief"))
        before = self.keyed
        self.verify(first.join(pairs, ["key", "chief"]).dropDuplicates(["key", "chief"]))
        if self.keyed is before:
            rest = pairs
        else:
            rest = self.current(pairs)
        self.verify(rest.join(first, ["key", "chief"], "left_anti").dropDuplicates(["key", "chief"]))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): class_id, class_size, kept, row_md5 (of the text).

    class_id is the least doc_id of the class; that document stays. A text of fewer than five words is one shingle;
    a text without words (null, empty) is a class of its own. One row of a class stays: of rows that repeat its doc_id
    the one of the least digest, of equal rows one; a class whose rows all lack a doc_id has none either and keeps the
    row of the least digest. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    inverse = spark.sparkContext.broadcast(inverse_frequencies(docs))
    signed = docs.withColumn("row_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).mapInArrow(_signature_rows(inverse), "doc_id long, row_md5 string, key binary, bands array<long>")
    rows = _stored(signed.groupBy("doc_id", "row_md5", "key", "bands").agg(F.count(F.lit(1)).alias("copies")))
    # In order of the rows that stay: rows with a doc_id first.
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_md5")
    nodes = _stored(rows.where("key is not null").groupBy("key", "bands").agg(F.sum("copies").alias("copies"), F.min(own).alias("first")))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    # Only bands that nodes share, found by a combined count.
    crowded = _stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bands = _stored(banded.join(crowded, "band"))
    wanted = spark.sparkContext.broadcast(_filter(bands.select("key").distinct()))
    texts = _stored(docs.select("text").mapInArrow(_text_rows(wanted), "key binary, text string").groupBy("key").agg(F.max("text").alias("text")))

    classes = _Classes(bands, texts, inverse)
    for step in range(2):
        classes.verify(_with_chiefs(classes.placed, step).dropDuplicates(["key", "chief"]))
    classes.finish()
    wanted.unpersist()
    inverse.unpersist()

    named = nodes.join(classes.keyed, "key", "left").select("key", "copies", "first", F.coalesce("class", "key").alias("class"))
    sizes = named.groupBy("class").agg(F.sum("copies").alias("class_size"), F.min("first").alias("stays"))
    shared = _stored(named.select("key", "class").join(sizes, "class").drop("class").where("class_size > 1"))
    alone = F.col("class_size").isNull()
    joined = rows.join(shared, "key", "left").withColumn("_copy", F.explode(F.expr("sequence(1, copies)")))
    chosen = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row_md5") == F.col("stays.row_md5")) & (F.col("_copy") == 1)
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | chosen).alias("kept"),
        "row_md5",
    )
