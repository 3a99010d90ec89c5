"""Invented but stable card, merchant and country for a transaction id.

Two hashes are offered. The SQL one (SHA-256, 52 bits) stays in generated code.
The keyed one (BLAKE2b, 64 bits) reproduces identities that were handed out with
that hash, and runs in Arrow batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size and skew of the card portfolio, places and merchants.
CARD_COUNT = 5_000
CARD_WEIGHT_EXPONENT = 0.5
HOME_COUNTRIES = ("US", "GB", "DE", "FR", "CA", "AU", "IN", "BR")
FOREIGN_COUNTRIES = ("NG", "RU", "CN", "MX", "RO", "TR")
FOREIGN_SHARE = 0.03
MERCHANTS = (
    "corner-grocer",
    "fuel-stop",
    "coffee-bar",
    "online-marketplace",
    "streaming-service",
    "pharmacy",
    "airline",
    "hotel-group",
    "electronics-store",
    "gaming-credits",
    "ride-hailing",
    "gift-cards",
)

BINS = 4_096


def sql_digest(value: Column, salt: str) -> Column:
    """The first 52 bits of SHA-256 over `salt|value`, as a bigint."""
    text = F.concat(F.lit(salt + "|"), value)
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def sql_fraction(value: Column, salt: str) -> Column:
    return sql_digest(value, salt).cast("double") / F.lit(float(1 << 52))


def keyed_digest(value: str, salt: str) -> int:
    """64 bits of BLAKE2b, big-endian, personalised by the salt."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8, person=salt.encode()).digest(), "big")


def card_ends() -> np.ndarray:
    """Where in [0, 1) the ranges of all cards but the last end.

    Cards have ranges one behind the other, as wide as their weight rank ** -CARD_WEIGHT_EXPONENT has a share in all
    weights; the last one takes whatever is left.
    """
    upto = np.cumsum(np.arange(1.0, CARD_COUNT + 1) ** -CARD_WEIGHT_EXPONENT)
    return (upto / upto[-1])[:-1]


def card_table(spark: SparkSession) -> DataFrame:
    """For each of BINS equal parts of [0, 1): the cards whose range ends before it, and the ends inside it.

    As many rows as bins, whatever the data.
    """
    ends = card_ends()
    edges = np.searchsorted((ends * BINS).astype(int), np.arange(BINS + 1))
    rows = [(b, int(edges[b]), ends[edges[b] : edges[b + 1]].tolist()) for b in range(BINS)]
    return spark.createDataFrame(rows, "_bin int, _before int, _ends array<double>")


def with_card(df: DataFrame, fraction: Column) -> DataFrame:
    """Adds `card_id`: the card in whose range the fraction falls, found by an equi-join on its bin."""
    drawn = df.withColumn("_u", fraction).withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    rank = F.col("_before") + F.size(F.filter("_ends", lambda end: end <= F.col("_u")))
    joined = drawn.join(F.broadcast(card_table(df.sparkSession)), "_bin", "left")
    card = F.concat(F.lit("card-"), F.lpad(rank.cast("string"), 5, "0"))
    return joined.withColumn("card_id", card).drop("_u", "_bin", "_before", "_ends")


def pick(names: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), number.cast("int"))  # null for null, unlike element_at


def keyed_identity(own: Column) -> Column:
    """Card, merchant and country of an id by the keyed hash, as one struct: one call for a batch, one hash for an id of it."""

    @F.pandas_udf("card_id string, merchant string, country string")
    def identity(ids: pd.Series) -> pd.DataFrame:
        which, names = pd.factorize(ids)  # null is -1
        drawn = lambda salt: np.array([keyed_digest(name, salt) for name in names], np.uint64)
        cards = [f"card-{rank:05d}" for rank in np.searchsorted(card_ends(), drawn("card") / 2.0**64, side="right")]
        home = {card: HOME_COUNTRIES[keyed_digest(card, "home") % len(HOME_COUNTRIES)] for card in set(cards)}
        abroad = drawn("abroad") / 2.0**64 < FOREIGN_SHARE
        away = drawn("country") % np.uint64(len(FOREIGN_COUNTRIES))
        known = pd.DataFrame(
            {
                "card_id": cards,
                "merchant": [MERCHANTS[k] for k in (drawn("merchant") % np.uint64(len(MERCHANTS))).tolist()],
                "country": [FOREIGN_COUNTRIES[k] if out else home[card] for k, out, card in zip(away.tolist(), abroad, cards)],
            },
            dtype=object,
        )
        return known.reindex(which).where(lambda cells: cells.notna(), None).reset_index(drop=True)

    return identity(own)


def with_identities(df: DataFrame, id_column: str = "transaction_id", keyed: bool = False) -> DataFrame:
    """Adds `card_id`, `merchant` and `country`. They depend on the id alone: merchant
    is uniform, the home country follows the card, a few transactions are abroad. Without an id all three are null."""
    own = F.col(id_column)
    if keyed:
        known = df.withColumn("_known", keyed_identity(own))
        return known.withColumns({name: F.col("_known")[name] for name in ("card_id", "merchant", "country")}).drop("_known")
    choice = lambda value, salt, names: pick(names, F.pmod(sql_digest(value, salt), F.lit(len(names))))
    carded = with_card(df, sql_fraction(own, "card"))
    abroad, home = choice(own, "country", FOREIGN_COUNTRIES), choice(F.col("card_id"), "home", HOME_COUNTRIES)
    return carded.withColumns(
        {
            "merchant": choice(own, "merchant", MERCHANTS),
            "country": F.when(sql_fraction(own, "abroad") < FOREIGN_SHARE, abroad).otherwise(home),
        }
    )
