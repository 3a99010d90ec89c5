"""The transaction message contract: raw bytes in, checked rows or named problems out.

Everything is expressions over the VARIANT type, so validation stays on the JVM
and widens with the cluster. A problem names the field and the reason, never the
rejected value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prep import RAW_FEATURES

# Limits, patterns and the wording of problems.
MAX_MESSAGE_BYTES = 16_384
MAX_BATCH_ROWS = 1_000
MAX_ID_LENGTH = 64
ENTITY_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}$"
COUNTRY_PATTERN = "^[A-Z]{2}$"
EMPTY = "empty message"
TOO_LONG = "message is {} bytes; a transaction is at most 16384"
NOT_JSON = "Invalid JSON"
NOT_AN_OBJECT = "Input should be an object"
REQUIRED = "Field required"
EXTRA = "Extra inputs are not permitted"
NOT_A_NUMBER = "Input should be a valid number"
NOT_PARSED = "Input should be a valid number, unable to parse string as a number"
NOT_FINITE = "Input should be a finite number"
NEGATIVE = "Input should be greater than or equal to 0"
NOT_A_STRING = "Input should be a valid string"
TOO_SHORT = "String should have at least 1 character"
TOO_MANY = "String should have at most 64 characters"
NO_MATCH = "String should match pattern '{}'"
NO_ID = "transaction_id: required on the stream"
OTHER_KEY = "key does not match transaction_id"

NON_NEGATIVE = ("Time", "Amount")
ENTITIES = {"card_id": ENTITY_PATTERN, "merchant": ENTITY_PATTERN, "country": COUNTRY_PATTERN}
FIELDS = ("transaction_id", *RAW_FEATURES, *ENTITIES)

_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
_BARE_SPECIAL = r"([:\[,]\s*)(-?(?:NaN|Infinity))(\s*[,}\]])"

# One message in brackets: numbers strictly numeric, texts as variants to keep their JSON type.
_TYPED = (
    "array<struct<"
    + ", ".join([*(f"{n}: double" for n in RAW_FEATURES), *(f"{n}: variant" for n in ("transaction_id", *ENTITIES))])
    + ">>"
)


def matches(value: Column, pattern: str) -> Column:
    """A whole-string match; `$` alone would let a closing line break through."""
    return value.rlike(pattern[:-1] + r"\z")


def entity_problem(name: str) -> Column:
    """Why an optional identity column is refused, null when it is fine or absent."""
    value, pattern = F.col(name), ENTITIES[name]
    return F.when(value.isNotNull() & ~matches(value, pattern), F.lit(f"{name}: {NO_MATCH.format(pattern)}"))


def _parsed(text: Column) -> Column:
    """A variant, or null. The wrapping brackets make trailing text an error."""
    # A bare NaN or Infinity is valid input to be refused by name, though not valid JSON:
    # it is quoted, but only where the text does not parse as it stands.
    whole = lambda t: F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    quoted = F.regexp_replace(text, _BARE_SPECIAL, '$1"$2"$3')
    return F.coalesce(whole(text), whole(F.regexp_replace(quoted, _BARE_SPECIAL, '$1"$2"$3')))


def _members(got: Column, names: Sequence[str]) -> Column:
    """Array of (name, raw, kind, text) per field, null raw when absent. Stepwise, so that the
    plan holds one small lambda per step however many fields there are."""
    found = F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.struct(n.alias("name"), F.try_element_at(got, n).alias("raw")))
    return F.transform(
        found,
        lambda f: F.struct(
            f["name"].alias("name"),
            f["raw"].alias("raw"),
            F.schema_of_variant(f["raw"]).alias("kind"),
            F.try_variant_get(f["raw"], "$", "string").alias("text"),
        ),
    )


def _numbers(members: Column) -> Column:
    """Array of (name, absent, kind, number): numeric text counts as a number."""

    def number(f: Column) -> Column:
        text = f["text"]
        from_text = F.when(text.rlike(_DECIMAL), F.trim(text).try_cast("double")).when(
            text.rlike(_SPECIAL), F.when(F.lower(text).contains("nan"), float("nan")).otherwise(float("inf"))
        )
        return F.when(f["kind"] == "STRING", from_text).otherwise(F.try_variant_get(f["raw"], "$", "double"))

    return F.transform(
        members,
        lambda f: F.struct(
            f["name"].alias("name"), f["raw"].isNull().alias("absent"), f["kind"].alias("kind"), number(f).alias("number")
        ),
    )


def _number_problem(f: Column) -> Column:
    said = lambda reason: F.concat(f["name"], F.lit(f": {reason}"))
    number = f["number"]
    return (
        F.when(f["absent"], said(REQUIRED))
        .when(number.isNull(), F.when(f["kind"] == "STRING", said(NOT_PARSED)).otherwise(said(NOT_A_NUMBER)))
        .when(F.isnan(number) | (F.abs(number) == float("inf")), said(NOT_FINITE))
        .when(f["name"].isin(*NON_NEGATIVE) & (number < 0), said(NEGATIVE))
    )


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once and then only read.

    A plain projection would be inlined again by every later reference and by
    every filter pushed below it, and these expressions feed many others. The
    one-row generator above the projection is where the optimizer stops doing that.
    """
    computed = df.withColumns(columns)
    return computed.select(*df.columns, F.inline(F.array(F.struct(*columns))))


def decode(messages: DataFrame, require_id: bool = True) -> DataFrame:
    """Adds the decoded columns and `problem` (null for a valid message) to raw messages.

    Input: `key` and `value` as bytes. `require_id=False` is the batch path, where
    an omitted id is generated before the first write.
    """
    kept = list(messages.columns)
    size, names = F.length("value"), ("transaction_id", *ENTITIES)
    step = _held(messages, _text=F.when(size <= MAX_MESSAGE_BYTES, F.try_validate_utf8(F.col("value").cast("string"))))
    text = F.col("_text")  # null where it can't be read
    wrapped = F.concat(F.lit("["), text, F.lit("]"))

    # Nearly every message is fine. One typed parse and a few comparisons show it;
    # only the others are taken apart as variants to say what is wrong.
    typed = F.from_json(wrapped, _TYPED, {"allowSingleQuotes": "false"})
    step = _held(step, _typed=typed, _keys=F.json_object_keys(text))
    step = _held(step, _quick=F.when(F.size("_typed") == 1, F.get("_typed", F.lit(0))))
    quick = lambda n: F.col(f"_quick.{n}")
    as_text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    absent = lambda v: v.isNull() | F.is_variant_null(v)
    sound = [F.abs(quick(n)) < F.lit(float("inf")) for n in RAW_FEATURES]
    sound += [quick(n) >= 0 for n in NON_NEGATIVE]
    sound.append(F.length(as_text(quick("transaction_id"))).between(1, MAX_ID_LENGTH))
    sound += [absent(quick(n)) | matches(as_text(quick(n)), pattern) for n, pattern in ENTITIES.items()]
    known = F.array(*(F.lit(n) for n in FIELDS))
    sound.append(F.size(F.array_except("_keys", known)) == 0)
    step = _held(step, _fine=F.coalesce(reduce(lambda a, b: a & b, sound), F.lit(False)))

    step = _held(step, _all=F.when(~F.col("_fine"), _parsed(text)))
    only = F.try_variant_get("_all", "$[1]", "variant").isNull()
    step = _held(step, _doc=F.when(only, F.try_variant_get("_all", "$[0]", "variant")))
    is_object = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    step = _held(step, _got=F.when(is_object, F.try_variant_get("_doc", "$", "map<string,variant>")))
    apart = lambda array: F.when(F.col("_got").isNotNull(), array)
    step = _held(
        step,
        _numbers=apart(_numbers(_members(F.col("_got"), RAW_FEATURES))),
        _texts=apart(_members(F.col("_got"), names)),
    )
    part = lambda i, what: F.get("_texts", F.lit(i))[what]
    ident, ident_kind = part(0, "text"), part(0, "kind")

    said = lambda name, reason: F.lit(f"{name}: {reason}")
    opening = F.when(
        ident_kind.isNotNull(),
        F.when(ident_kind != "STRING", said("transaction_id", NOT_A_STRING))
        .when(F.length(ident) < 1, said("transaction_id", TOO_SHORT))
        .when(F.length(ident) > MAX_ID_LENGTH, said("transaction_id", TOO_MANY)),
    )
    closing = [
        F.when(
            part(i, "kind") != "VOID",
            F.when(part(i, "kind") != "STRING", said(name, NOT_A_STRING)).when(
                ~matches(part(i, "text"), pattern), said(name, NO_MATCH.format(pattern))
            ),
        )
        for i, (name, pattern) in enumerate(ENTITIES.items(), 1)
    ]
    unknown = F.array_except(F.map_keys("_got"), known)
    extras = F.transform(unknown, lambda name: F.concat(name, F.lit(f": {EXTRA}")))
    problems = F.transform("_numbers", _number_problem)
    listed = F.array_join(F.concat(F.array(opening), problems, F.array(*closing), extras), "; ")
    fine = F.col("_fine")
    own_id = F.when(fine, as_text(quick("transaction_id"))).otherwise(F.when(ident_kind == "STRING", ident))
    step = _held(step, _listed=F.when(~fine, listed), _id=own_id)
    before, after = TOO_LONG.split("{}")
    refused = (
        F.when(F.col("value").isNull() | (size == 0), F.lit(EMPTY))
        .when(size > MAX_MESSAGE_BYTES, F.concat(F.lit(before), size, F.lit(after)))
        .when(~fine & F.col("_doc").isNull(), F.lit(NOT_JSON))
        .when(~fine & F.col("_got").isNull(), F.lit(NOT_AN_OBJECT))
        .when(F.col("_listed") != "", F.col("_listed"))
    )
    if require_id:
        refused = refused.when(F.col("_id").isNull(), F.lit(NO_ID))
    wrong_key = F.col("key").isNotNull() & F.col("_id").isNotNull() & (F.col("key") != F.col("_id").cast("binary"))
    refused = refused.when(wrong_key, F.lit(OTHER_KEY))
    slow_number = lambda i: F.get("_numbers", F.lit(i))["number"]
    slow_text = lambda i: F.when(part(i, "kind") == "STRING", part(i, "text"))
    return _held(step, problem=refused).select(
        *kept,
        F.col("_id").alias("transaction_id"),
        *(F.when(fine, quick(n)).otherwise(slow_number(i)).alias(n) for i, n in enumerate(RAW_FEATURES)),
        *(F.when(fine, as_text(quick(n))).otherwise(slow_text(i)).alias(n) for i, n in enumerate(ENTITIES, 1)),
        "problem",
    )


def with_generated_ids(valid: DataFrame) -> DataFrame:
    """Ids for batch rows that came without one. Never used on a replayable stream,
    where a second delivery would be given another id."""
    return valid.withColumn("transaction_id", F.coalesce("transaction_id", F.regexp_replace(F.expr("uuid()"), "-", "")))


def batch_problems(rows: DataFrame, max_rows: int = MAX_BATCH_ROWS) -> DataFrame:
    """Why a batch is refused as a whole: too few or many rows, or repeated ids (ten are named)."""
    counted = rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated"))
    named = counted.where("_n > 1").orderBy("transaction_id").limit(10)
    ids = named.agg(F.array_sort(F.collect_list("transaction_id")).alias("ids")).withColumn("_one", F.lit(1))
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(ids), "_one").select(
        "rows", "repeated",
        F.array_join("ids", ", ").alias("first_repeated"),
        (F.col("rows").between(1, max_rows) & (F.col("repeated") == 0)).alias("accepted"),
    )


def checked_batch(rows: DataFrame, max_rows: int = MAX_BATCH_ROWS) -> DataFrame:
    """The rows, or an error before anything is scored: a batch is all or nothing."""
    verdict = batch_problems(rows, max_rows).first()
    if verdict["repeated"]:
        raise ValueError(f"duplicate transaction_id in batch: {verdict['first_repeated']}")
    if not verdict["accepted"]:
        raise ValueError(f"{verdict['rows']} rows where 1 to {max_rows} are allowed")
    return rows
