import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import contract as C
from riskloom.operators.prep import RAW_FEATURES
from riskloom.sources import messages as M


def body(drop=(), **changes):
    doc = {"transaction_id": "tx-1", **{name: 0.5 for name in RAW_FEATURES}}
    doc.update(changes)
    return json.dumps({k: v for k, v in doc.items() if k not in drop}).encode()


def problems(spark, *records):
    rows = [(i, k, v, "transactions", 0, i) for i, (k, v) in enumerate(records)]
    schema = "n int, key binary, value binary, topic string, partition int, offset bigint"
    decoded = C.decode(spark.createDataFrame(rows, schema))
    return [r["problem"] for r in decoded.orderBy("n").collect()]


def test_valid_messages(spark):
    good = [
        (b"tx-1", body()),
        (None, body()),
        (b"tx-1", body(card_id="card-1", merchant="shop.a:b_c", country="GB")),
        (b"tx-1", body(card_id=None)),
        (b"tx-1", body(V3="1.5", V4=True, V5=-3)),
        (b"tx-1", body().replace(b'{"transaction_id"', b'{"transaction_id": "old", "transaction_id"')),
    ]
    assert problems(spark, *good) == [None] * len(good)


@pytest.mark.parametrize("nothing", [None, b""])
def test_empty(spark, nothing):
    assert problems(spark, (b"tx-1", nothing)) == ["empty message"]


def test_refusals(spark):
    cases = [
        (b"hello", "Invalid JSON"),
        (b"\xff\xfe{}", "Invalid JSON"),
        (body() + b" x", "Invalid JSON"),
        (body() + b", 1", "Invalid JSON"),
        (b"[1, 2, 3]", "Input should be an object"),
        (b'"text"', "Input should be an object"),
        (body(drop=["V14"]), "V14: Field required"),
        (body(Class=1), "Class: Extra inputs are not permitted"),
        (body(v14=1), "v14: Extra inputs are not permitted"),
        (body(V3=float("nan")), "V3: Input should be a finite number"),
        (body(V3=float("-inf"), V4=float("nan")), "V3: Input should be a finite number; V4: Input should be a finite number"),
        (body(V3="NaN"), "V3: Input should be a finite number"),
        (body(V3="abc"), "V3: Input should be a valid number, unable to parse string as a number"),
        (body(V3=None), "V3: Input should be a valid number"),
        (body(V3=[1]), "V3: Input should be a valid number"),
        (body(drop=["V14"], Amount=-5), "V14: Field required; Amount: Input should be greater than or equal to 0"),
        (b" " * (16_385 - len(body())) + body(), "message is 16385 bytes; a transaction is at most 16384"),
        (body(drop=["transaction_id"]), "transaction_id: required on the stream"),
        (body(transaction_id="other"), "key does not match transaction_id"),
        (body(transaction_id=7), "transaction_id: Input should be a valid string"),
        (body(transaction_id=""), "transaction_id: String should have at least 1 character"),
        (body(transaction_id="x" * 65), "transaction_id: String should have at most 64 characters"),
        (body(card_id="card 1"), "card_id: String should match pattern '^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}$'"),
        (body(country="GBR\n"), "country: String should match pattern '^[A-Z]{2}$'"),
        (body(country="GB\n"), "country: String should match pattern '^[A-Z]{2}$'"),
        (body(merchant=5), "merchant: Input should be a valid string"),
    ]
    got = problems(spark, *((b"tx-1", value) for value, _ in cases))
    assert got == [reason for _, reason in cases]


def test_a_long_but_allowed_message(spark):
    assert problems(spark, (b"tx-1", b" " * (16_384 - len(body())) + body())) == [None]


@pytest.mark.parametrize(
    "name,bad",
    [("card_id", "card 1"), ("card_id", "-card"), ("card_id", "x" * 65), ("merchant", "shop//name"), ("country", "gb"), ("country", "GBR")],
)
def test_bad_identities(spark, name, bad):
    row = spark.createDataFrame([(bad,)], f"{name} string").select(C.entity_problem(name).alias("p")).first()
    assert row["p"].startswith(f"{name}: String should match pattern")


def test_values_never_leak(spark):
    (reason,) = problems(spark, (b"tx-1", body(V3="secret-value", Amount=-123456)))
    assert "secret" not in reason and "123456" not in reason


def test_dead_letter_and_headers(spark):
    rows = [(b"tx-1", b"not json", "transactions", 2, 4711, "why"), (None, None, "transactions", 0, 1, "empty message")]
    refused = spark.createDataFrame(
        rows, "key binary, value binary, topic string, partition int, offset bigint, problem string"
    )
    letters = M.dead_letters(refused, F.to_timestamp(F.lit("2026-09-16 12:00:00")))
    out = letters.select(
        "key", "value", *(M.header(F.col("headers"), n).alias(n.replace("-", "_")) for n in (M.REASON, M.TOPIC, M.PARTITION, M.OFFSET, M.FAILED_AT)),
        M.header(F.col("headers"), "absent").alias("absent"),
    ).collect()
    assert bytes(out[0]["value"]) == b"not json"
    assert tuple(out[0])[2:] == ("why", "transactions", "2", "4711", "2026-09-16T12:00:00+00:00", None)
    assert bytes(out[1]["value"]) == b"" and out[1]["key"] is None


def test_last_message_wins_and_commits(spark):
    rows = [("tx-1", 10.0, "t", 0, 4), ("tx-2", 5.0, "t", 0, 5), ("tx-1", 99.0, "t", 1, 9)]
    valid = spark.createDataFrame(rows, "transaction_id string, Amount double, topic string, partition int, offset bigint")
    kept = {r["transaction_id"]: r["Amount"] for r in M.last_wins(valid).collect()}
    assert kept == {"tx-1": 99.0, "tx-2": 5.0}
    commits = {r["partition"]: r["resume_at"] for r in M.commit_offsets(valid).collect()}
    assert commits == {0: 6, 1: 10}


def test_lag(spark):
    known = spark.createDataFrame([(0, 12, 7), (1, 4, 4)], "partition int, high_water bigint, position bigint")
    assert {r["partition"]: r["lag"] for r in M.lag(known).collect()} == {0: 5, 1: 0}
    assert M.total_lag(known).first()[0] == 5
    unknown = spark.createDataFrame([(0, None, 7), (1, 4, 4)], "partition int, high_water bigint, position bigint")
    assert M.total_lag(unknown).first()[0] is None


def test_batches_are_all_or_nothing(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "transaction_id string")
    assert C.checked_batch(ids("a", "b")).count() == 2
    with pytest.raises(ValueError, match="duplicate transaction_id in batch: a, b"):
        C.checked_batch(ids("b", "a", "a", "b", "c"))
    with pytest.raises(ValueError, match="1 to 1000"):
        C.checked_batch(ids())
    with pytest.raises(ValueError, match="1 to 2"):
        C.checked_batch(ids("a", "b", "c"), 2)


def test_generated_ids_are_distinct(spark):
    rows = spark.createDataFrame([("kept",), (None,), (None,)], "transaction_id string")
    ids = [r[0] for r in C.with_generated_ids(rows).collect()]
    assert "kept" in ids and len(set(ids)) == 3 and all(ids)


def test_encoded_messages_are_accepted(spark):
    row = {"transaction_id": "tx-9", **{n: 1.25 for n in RAW_FEATURES}, "card_id": "c-1", "merchant": None, "country": "GB"}
    schema = "transaction_id string, " + ", ".join(f"{n} double" for n in RAW_FEATURES) + ", card_id string, merchant string, country string"
    encoded = M.encode(spark.createDataFrame([tuple(row.values())], schema))
    decoded = C.decode(encoded).first()
    assert decoded["problem"] is None and decoded["V7"] == 1.25 and decoded["merchant"] is None
    assert json.loads(bytes(encoded.first()["value"]))["merchant"] is None
