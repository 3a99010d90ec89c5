"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

A blob is a distinct text, named by its SHA-256. The ledger has a row for every pair of blob and rule version ever
scanned, with the spans found; a scan takes the pairs the ledger lacks, and findings are joined back to every path
(document) that holds the blob, in whatever version of the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpointed, run_folder


@dataclass(frozen=True)
class Rule:
    """A named pattern; `holds` decides on a match, and a changed rule gets another `version`."""

    kind: str
    pattern: str
    holds: Callable[[Column], Column]
    version: int = 1


# Fixed by the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    # A run is taken whole, so the least length can stand in the pattern; for assignments it can't, as a match that is
    # too short still uses up its text.
    Rule("access", "AKIA[A-Z0-9]{16,}", lambda m: F.lit(True)),
    Rule("hex", "[0-9a-f]{24,}", lambda m: F.lit(True)),
)
PARTS = "array<struct<gap:int,len:int,ok:boolean>>"
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _parts(text: Column, rule: Rule) -> Column:
    """Lengths, in code points, of each match and of the text before it; empty where nothing matches."""
    pairs = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda before, match: F.struct(
            F.char_length(before).alias("gap"),
            F.coalesce(F.char_length(match), F.lit(0)).alias("len"),
            (match.isNotNull() & rule.holds(match)).alias("ok"),
        ),
    )
    return F.when(text.rlike(rule.pattern), pairs.cast(PARTS)).otherwise(F.array().cast(PARTS))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows to add to the ledger (LEDGER): one for each blob of `docs` (text) and rule version it does not have yet.

    Null text is empty. A blob that many documents hold is scanned once; copies are combined before the shuffle.
    """
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        blobs = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    pending = F.array(
        *(
            F.when(
                ~F.array_contains("seen", f"{r.kind}:{r.version}"),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _parts(F.col("text"), r).alias("parts")),
            )
            for r in rules
        )
    )
    scanned = blobs.select("blob", F.explode(F.filter(pending, lambda p: p.isNotNull())).alias("p"))
    rows = scanned.select("blob", "p.kind", "p.version", F.posexplode_outer("p.parts").alias("i", "part"))
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("part.gap") + F.col("part.len")).cast("long")).over(upto)
    spans = rows.select("blob", "kind", "version", F.col("part.ok").alias("ok"), (end - F.col("part.len")).alias("start"), end.alias("end"))
    found = F.collect_list(F.when(F.col("ok"), F.struct("start", "end")))
    return spans.groupBy("blob", "kind", "version").agg(F.sort_array(found).alias("spans"))


def record(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, folder: str | None = None) -> DataFrame:
    """Scans what is unseen, stores it, and returns the ledger with it; the store is the shared folder unless named."""
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "secret-ledger")
    scan(docs, ledger, rules).write.mode("append").parquet(folder)
    added = spark.read.parquet(folder)
    return added if ledger is None else ledger.unionByName(added)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts by kind and all spans as kind:start:end, by start and then kind.

    A null doc_id stays null; repeated rows have a row each.
    """
    current = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
    rank = F.coalesce(*(F.when(F.col("kind") == r.kind, F.lit(k)) for k, r in enumerate(rules)))
    hits = ledger.where(current & (F.size("spans") > 0)).select("blob", "kind", rank.alias("rank"), F.explode("spans").alias("s")).distinct()
    entry = F.struct(F.col("s.start"), "rank", F.concat_ws(":", "kind", "s.start", "s.end").alias("text"))
    by_blob = hits.groupBy("blob").agg(
        *(F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules),
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["text"]), ",").alias("spans"),
    )
    # Stored, so that the join shuffles both sides itself and adaptive execution can split a blob that many paths hold.
    by_blob = checkpointed(by_blob)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(F.col("text")).alias("blob"))
    joined = paths.join(by_blob, "blob", "left")
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Findings of all documents from an empty ledger. The method adds no spans to the rules' own."""
    return findings(docs, record(docs)).select("*", F.sha2("spans", 256).alias("base_sha256"))
