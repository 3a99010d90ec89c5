"""Prefix trie of conversations as burst tries: shared openings are nodes, counted once.

A conversation is its sequence of turn ids, 16 bytes each. Suffixes are kept in containers under the heads of the trie,
at first all in one under the root. A container with too many turns bursts: what all its suffixes share becomes a chain of
heads, and the next turn id deals them to the containers below. Containers that are left are sorted and swept: neighbours
share what the trie shares, so a stack of open nodes suffices. Heads get their sums from the containers below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranking import broadcast_if_small
from riskloom.session import checkpointed, ship

ID = 16  # bytes of a turn id
MOST_TURNS = 1 << 14  # of the suffixes in a container; one with a single suffix, a path, may be longer
CHUNK = 1 << 16  # conversation ids in one piece of a list that is hashed piece by piece
GROUP, BORROWED = 20, 4  # fixed by the contract: whose first turns a conversation takes over, and below how many
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of each conversation of (conv_id, turn, role, text), in order of its turns.

    `ids` is the concatenation of turn ids, which two turns of equal role and text have in common; `words` counts the
    words of each. A null turn comes first, turns of equal number go by their ids; null role or text is empty. Rows that
    repeat are turns of their own. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(digest, 1, 2 * ID).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t"))
    return own.select("conv_id", F.unhex(F.array_join(F.col("t.id"), "")).alias("ids"), F.col("t.words").alias("words"))


def _first(ids: Column, turns: Column | int) -> Column:
    """The ids of the first turns."""
    return F.substring(ids, F.lit(1), (F.lit(turns) if isinstance(turns, int) else turns) * ID)


def rebuilt(sequences: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group, h = crc32(c) % borrowed.

    An absent donor lends none. One donor lends to fewer than twice `group` conversations, and its first turns only.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % borrowed).cast("int")
    lent = sequences.where(c % group == 0).select(c.alias("_donor"), _first(F.col("ids"), borrowed).alias("_ids"), F.slice("words", 1, borrowed).alias("_words"))
    taken = sequences.withColumn("_h", h).join(lent, (c - c % group) == F.col("_donor"), "left")
    none = F.array().cast("array<int>")
    size = F.size("words")
    ids = F.concat(_first(F.coalesce("_ids", F.lit(b"")), F.col("_h")), F.substring("ids", F.col("_h") * ID + 1, F.greatest(size - F.col("_h"), F.lit(0)) * ID))
    words = F.concat(F.slice(F.coalesce("_words", none), F.lit(1), F.col("_h")), F.slice("words", F.col("_h") + 1, size))
    return taken.select("conv_id", ids.alias("ids"), words.alias("words"))


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, chunk, text) to (key, ends): the SHA-256 of a key's texts with commas between, fed one by one."""
    key, state = None, None
    for batch in batches:
        keys, ends = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    ends.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])


def _whole(ids: Column) -> Column:
    return F.unhex(F.sha2(ids, 256))


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends) of each sequence: the digest of its conversations' ids in ascending order.

    Ids are joined in chunks of consecutive ones, so that the conversations of a sequence are never one value, and a
    sequence that a third of all conversations share is a few rows.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy(_whole(F.col("ids")).alias("key"), chunk.alias("chunk")).agg(text.alias("text"))
    dealt = chunks.repartition("key").sortWithinPartitions("key", "chunk")
    return dealt.mapInArrow(_joined_rows, "key binary, ends string")


def _shared_turns(a: Column, b: Column) -> Column:
    """How many leading turns two sequences of ids share."""
    least = F.floor(F.least(F.length(a), F.length(b)) / ID).cast("int")
    differ = F.filter(F.sequence(F.lit(0), least), lambda k: (k == least) | (F.substring(a, k * ID + 1, F.lit(ID)) != F.substring(b, k * ID + 1, F.lit(ID))))
    return F.element_at(differ, 1)


def _placed(entries: DataFrame, most: int) -> DataFrame:
    """Adds `at`, the depth of the head that the container of each sequence hangs from, and `ended`, whether it ends there.

    Round by round: containers (equal first `at` turns) with more than `most` turns burst to just below what all their
    sequences share, which the least and the greatest of them tell. A sequence that ends at the head goes no further.
    """
    settled, open_ = None, entries.select("key", "ids", F.lit(0).alias("at"))
    while True:
        open_ = checkpointed(open_)
        head = _whole(_first(F.col("ids"), F.col("at"))).alias("_head")
        counted = open_.groupBy(head, "at").agg(
            F.sum(F.length("ids") / ID - F.col("at") + 1).alias("_turns"), F.count(F.lit(1)).alias("_n"), F.min("ids").alias("_low"), F.max("ids").alias("_high")
        )
        bursting = checkpointed(
            counted.where((F.col("_turns") > most) & (F.col("_n") > 1)).select("_head", F.col("at").alias("_at"), _shared_turns(F.col("_low"), F.col("_high")).alias("_shared"))
        )
        done = bursting.isEmpty()
        if done:
            rest = open_.select("key", "at", F.lit(False).alias("ended"))
            return rest if settled is None else settled.unionByName(rest)
        same = (_whole(_first(F.col("ids"), F.col("at"))) == F.col("_head")) & (F.col("at") == F.col("_at"))
        moved = checkpointed(open_.join(broadcast_if_small(bursting), same, "left").drop("_head", "_at"))
        ends = F.length("ids") == F.col("_shared") * ID
        stay = moved.where(F.col("_shared").isNull() | ends).select(
            "key", F.coalesce("_shared", "at").alias("at"), F.col("_shared").isNotNull().alias("ended")
        )
        settled = stay if settled is None else settled.unionByName(stay)
        open_ = moved.where(F.col("_shared").isNotNull() & ~ends).select("key", "ids", (F.col("_shared") + 1).alias("at"))


NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _swept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sequences (home, at, ids, words, copies, least, ends) to the nodes of their containers.

    The top node of a container also has the `path` to it (ids and words); its parent is a head, found later.
    """
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path", "path_words"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())]
    home, last, top = None, b"", None
    stack: list[dict] = []
    done: list[dict] = []

    def close(depth: int) -> None:
        """Closes the open nodes from `depth` on, the deepest first, and adds them to their parents."""
        while stack and stack[-1]["depth"] >= depth:
            node = stack.pop()
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["last_words"]
            done.append(node)
            if stack:
                above = stack[-1]
                node["above"] = above
                above["n_children"] += 1
                above["conv_id"] = min(above["conv_id"], node["conv_id"])
                for name in ("n_convs", "n_leaves", "saved_tokens"):
                    above[name] += node[name]

    def flushed() -> pa.RecordBatch:
        close(0)
        for node in done:
            node["parent_conv_id"] = node["above"]["conv_id"] if node["above"] else None
        columns = [pa.array([node[name] for node in done], kind) for name, kind in zip(names, kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for row in batch.to_pylist():
            at, ids, words = row["at"], row["ids"], row["words"]
            size = len(ids) // ID
            if row["home"] != home:
                if done or stack:
                    yield flushed()
                home, shared = row["home"], at - 1
            else:
                shared = at
                while shared < min(size, len(last) // ID) and ids[shared * ID : shared * ID + ID] == last[shared * ID : shared * ID + ID]:
                    shared += 1
            close(shared + 1)
            for depth in range(shared + 1, size + 1):
                first = depth == at
                stack.append({
                    "depth": depth, "conv_id": row["least"], "above": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0,
                    "last_words": words[depth - 1] if depth else 0, "ends_sha256": NO_ENDS,
                    "path": ids[: at * ID] if first else None, "path_words": words[:at] if first else None,
                })
            node = stack[-1]
            node["n_convs"] += row["copies"]
            node["conv_id"] = min(node["conv_id"], row["least"])
            node["ends_sha256"] = row["ends"]
            last = ids
    if done or stack:
        yield flushed()


def _heads(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes above the containers, with the `head` each is known by and the `up` of its parent.

    `tops` are the containers' top nodes, `ended` the sequences that end at a head. Both go to every head above them:
    a container hangs from as many as it is deep.
    """
    part = lambda depth, *more: F.explode(F.transform(F.sequence(F.lit(0), depth), lambda d: F.struct(d.alias("depth"), *(m(d) for m in more))))
    own = lambda d: F.substring("path", F.lit(1), d * ID).alias("ids")
    last = lambda d: F.coalesce(F.try_element_at("path_words", d), F.lit(0)).alias("last_words")
    words = lambda d: F.when(d > 0, last(F.greatest(d, F.lit(1)))).otherwise(0).alias("last_words")
    below = tops.where("depth > 0").select(
        "conv_id", "n_convs", "n_leaves", "saved_tokens", (F.col("depth") - 1).alias("bottom"), F.lit(None).cast("string").alias("ends"), part(F.col("depth") - 1, own, words).alias("h")
    )
    there = ended.select(
        "conv_id", "n_convs", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(-1).alias("bottom"),
        "ends", part(F.col("depth"), own, words).alias("h"), F.col("depth").alias("_end"),
    )
    there = there.withColumn("ends", F.when(F.col("h.depth") == F.col("_end"), F.col("ends"))).drop("_end")
    summed = (
        below.unionByName(there)
        .groupBy(_whole(F.col("h.ids")).alias("head"), F.col("h.depth").alias("depth"))
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum((F.col("bottom") == F.col("h.depth")).cast("long")).alias("containers"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("below"),
            F.max("ends").alias("ends"),
            F.max("h.ids").alias("ids"),
            F.max("h.last_words").alias("last_words"),
        )
    )
    summed = checkpointed(summed.withColumn("own", (F.col("n_convs") - 1) * F.col("last_words")))
    # What a head saves itself counts for every head above it.
    chain = summed.select("own", F.col("depth").alias("_depth"), F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda d: F.struct(d.alias("d"), F.substring("ids", F.lit(1), d * ID).alias("ids")))).alias("h"))
    totals = chain.groupBy(_whole(F.col("h.ids")).alias("head")).agg(
        F.sum("own").alias("heads_own"), F.sum((F.col("h.d") == F.col("_depth") - 1).cast("long")).alias("heads_below")
    )
    up = F.when(F.col("depth") > 0, _whole(F.substring("ids", F.lit(1), (F.col("depth") - 1) * ID)))
    return checkpointed(
        summed.join(totals, "head").select(
            "head", up.alias("up"), "conv_id", "depth", "n_convs", (F.col("containers") + F.col("heads_below")).alias("n_children"), "n_leaves",
            (F.col("below") + F.col("heads_own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )


def prefix_trie(members: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row per node of the trie of `members` (conv_id, ids, words), see `turn_sequences`.

    conv_id is the smallest conversation that begins with the node's turns, n_convs how many do, n_children and n_leaves
    count nodes below, saved_tokens sums over the subtree what repeated turns would cost again, and ends_sha256 digests
    the ids of the conversations that end at the node. Equal conversations are one sequence with a number of copies. The
    result does not depend on `most_turns`. A conversation is one row of 20 bytes a turn, a sequence of many copies is one
    row too; an empty table gives no rows, not even the root.
    """
    ship(members.sparkSession)
    members = checkpointed(members)
    ends = _ends(members)
    counted = members.groupBy(_whole(F.col("ids")).alias("key"), "ids", "words").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"))
    entries = checkpointed(counted.join(ends, "key"))
    placed = checkpointed(entries.join(_placed(entries, most_turns), "key"))
    dealt = placed.where("not ended").withColumn("home", _whole(_first(F.col("ids"), F.col("at"))))
    dealt = dealt.select("home", "at", "ids", "words", "copies", "least", "ends").repartition("home").sortWithinPartitions("home", "at", "ids")
    swept = checkpointed(dealt.mapInArrow(_swept_rows, NODE + ", path binary, path_words array<int>"))
    tops = swept.where("path is not null and depth > 0")
    ended = placed.where("ended").select(
        F.col("least").alias("conv_id"), F.col("copies").alias("n_convs"), "ends", F.col("at").alias("depth"), F.col("ids").alias("path"), F.col("words").alias("path_words")
    )
    heads = _heads(tops, ended)
    names = [f.split()[0] for f in NODE.split(", ")]
    known = heads.select(F.col("head").alias("_up"), F.col("conv_id").alias("_up_conv"))
    below = tops.withColumn("_of", _whole(F.substring("path", F.lit(1), (F.col("depth") - 1) * ID)))
    below = below.join(broadcast_if_small(known), F.col("_of") == F.col("_up")).withColumn("parent_conv_id", F.col("_up_conv")).select(*names)
    above = heads.join(broadcast_if_small(known), F.col("up") == F.col("_up"), "left").withColumn("parent_conv_id", F.col("_up_conv")).select(*names)
    inner = swept.where("path is null or depth = 0").select(*names)
    return inner.unionByName(below).unionByName(above).withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """The nodes of the rebuilt conversations of (conv_id, turn, role, text): see `rebuilt` and `prefix_trie`."""
    sequences = checkpointed(turn_sequences(conversations))
    return prefix_trie(rebuilt(sequences), most_turns)
