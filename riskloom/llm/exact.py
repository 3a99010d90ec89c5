"""Exact de-duplication with content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal texts have equal chunks. Chunks travel
once, to prove that an identifier stands for one content; after that a document is its recipe, the list of its chunk
identifiers (under one per cent of the text), and documents are equal when their recipes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import as_bytes, mixed, pieces, small_batches
from riskloom.session import checkpointed

LEAST, MOST, CUT_BITS = 512, 16_384, 11  # chunk bytes at least, at most, and about 2**11 between cuts
STEP = 1 << 20  # bytes whose rolling hash is computed at once
KEPT_BYTES = 16 << 20  # chunks a task remembers so as not to send them again

# Fixed: what a comparison of texts leaves out, [\x20\x09-\x0D].
STAYS = np.ones(256, bool)
STAYS[0x09:0x0E] = STAYS[0x20] = False

_GEAR = (mixed(np.arange(256, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32)


def cuts(norm: np.ndarray) -> list[int]:
    """Ends of the chunks of one normalised text; the last is its length. An empty text has none."""
    n = len(norm)
    found = []
    if n > LEAST:
        for lo in range(0, n, STEP):
            before = min(lo, 31)
            b = norm[lo - before : lo + STEP]
            h = _GEAR[b]
            for shift in (1, 2, 4, 8, 16):  # after these steps h[i] covers the last 32 bytes
                h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
            found.append(np.flatnonzero(h[before:] >> np.uint32(32 - CUT_BITS) == 0) + lo + 1)
    out, last = [], 0
    for at in np.concatenate(found).tolist() if found else ():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _identifier(chunk: bytes, salt: int, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size, salt=salt.to_bytes(4, "little")).digest()


def _normal(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its code points and its bytes without white space."""
    data, at = as_bytes(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = data[a:b]
        yield int(np.count_nonzero((own & 0xC0) != 0x80)), own[STAYS[own]]


def _chunk_rows(salt: int, size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        weight = 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids, contents = [], []
                for _, norm in _normal(batch.column("text")):
                    last, raw = 0, norm.tobytes()
                    for end in cuts(norm):
                        chunk, last = raw[last:end], end
                        key = _identifier(chunk, salt, size)
                        if held.get(key) == chunk:
                            continue
                        if weight > KEPT_BYTES:
                            held.clear()
                            weight = 0
                        held[key] = chunk
                        weight += len(chunk)
                        ids.append(key)
                        contents.append(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["id", "content"])

    return chunks


def _recipe_rows(salt: int, size: int):
    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                lengths, digests, lists = [], [], []
                for n_chars, norm in _normal(batch.column("text")):
                    last, raw, ids = 0, norm.tobytes(), []
                    for end in cuts(norm):
                        ids.append(_identifier(raw[last:end], salt, size))
                        last = end
                    lengths.append(n_chars)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    lists.append(b"".join(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row_md5"), pa.array(lengths, pa.int64()), pa.array(digests), pa.array(lists, pa.binary())],
                    ["doc_id", "row_md5", "n_chars", "text_sha256", "recipe"],
                )

    return recipes


def verified_size(docs: DataFrame, first_size: int = 16) -> tuple[int, int]:
    """A salt and an identifier width for which no two different chunks of `docs` share an identifier.

    Every chunk is compared by its bytes with the others of its identifier (least and greatest of the group, combined
    before the shuffle, so a chunk that is everywhere is one row per task). A clash means another salt and a wider
    identifier, until there is none.
    """
    salt, size = 0, first_size
    while True:
        chunks = docs.select("text").mapInArrow(_chunk_rows(salt, size), "id binary, content binary")
        seen = chunks.groupBy("id").agg(F.min("content").alias("low"), F.max("content").alias("high"))
        if seen.where("low <> high").isEmpty():
            return salt, size
        salt, size = salt + 1, min(64, size * 2)


def exact_groups(docs: DataFrame, first_size: int = 16) -> DataFrame:
    """One row per row of `docs` (doc_id, text): keep_id, group_size, kept, text_sha256, n_chars, row_md5 (of the original text).

    Null text is empty; all empty texts are one group. Of equal texts the longest original stays, then the smallest
    doc_id; a null doc_id comes last. Of rows that repeat a doc_id and are as long the one of the greatest digest stays,
    of equal rows one. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("row_md5"))
    salt, size = verified_size(docs, first_size)
    recipes = docs.mapInArrow(_recipe_rows(salt, size), "doc_id long, row_md5 string, n_chars long, text_sha256 string, recipe binary")
    # Keyed by document as well, so that a group holding a third of all rows is spread.
    rows = checkpointed(
        recipes.groupBy("recipe", "text_sha256", "doc_id", "row_md5").agg(F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars"))
    )
    stays = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("k"), "row_md5"))
    groups = rows.groupBy("recipe").agg(F.sum("copies").alias("group_size"), stays.alias("stays"))
    # Stored, so that the join below shuffles both sides itself and adaptive execution can split a hot recipe.
    shared = checkpointed(groups.where("group_size > 1").select("recipe", "group_size", F.bitwise_not("stays.k").alias("keep_id"), F.col("stays.row_md5").alias("keep_md5")))
    joined = rows.join(shared, "recipe", "left").withColumn("_copy", F.explode(F.expr("sequence(1, copies)")))
    own = F.col("group_size").isNull()
    chosen = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_md5") == F.col("keep_md5"))
    return joined.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((own | chosen) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
        "n_chars",
        "row_md5",
    )


def only_kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that `decisions` (doc_id, row_md5, kept) keeps, with all their columns.

    A row is told by its doc_id, which may be null, and its text, so rows that share a doc_id are decided one by one. Of
    rows equal in both one stays.
    """
    stay = decisions.where("kept").select(F.col("doc_id").alias("_stay"), F.col("row_md5").alias("_text")).distinct()
    whole = docs.select(
        F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("_id"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("_md5")
    )
    kept = whole.join(stay, F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_md5") == F.col("_text")), "left_semi")
    return kept.dropDuplicates(["_id", "_md5"]).select("row.*")
