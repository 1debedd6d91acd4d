import pytest
from pyspark.sql import functions as F

from palaver.functions import text as tx, timefn as tf
from palaver.functions.body import body_text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def blob(text: bytes, length: bytes) -> bytearray:
    return bytearray(b"\x04\x0bstreamtyped\x81junkNSString\x01\x94\x84\x01\x2b" + length + text + b"\x86trailer")


def test_body_text(spark):
    long2, long4 = b"x" * 300, b"y" * 70000
    party = "héllo 🎉".encode()
    head = bytearray(b"\x04\x0bstreamtyped\x81junkNSString\x01\x94\x84\x01\x2b")
    got = column(spark, [
        blob(b"hello", bytes([5])), blob(long2, b"\x81" + (300).to_bytes(2, "little")),
        blob(long4, b"\x82" + (70000).to_bytes(4, "little")), blob(party, bytes([len(party)])),
        None, bytearray(b""), bytearray(b"no marker here"), head + b"\x81", head + b"\x81\x2c", head + b"\x82\x01\x02\x03",
        blob(b"hello", bytes([50]))], "binary", body_text)
    assert got == ["hello", "x" * 300, "y" * 70000, "héllo 🎉"] + [None] * 7


def test_source_time(spark):
    noon = "2023-03-15 12:00:00"
    got = column(spark, [700574400 * 10**9, 700574400, 0, None], "bigint", lambda c: tf.source_time(c).cast("string"))
    assert got == [noon, noon, None, None]


def test_normalize_handle(spark):
    got = column(spark, [" Alice@Example.com ", "+1 (555) 123-4567", "15551234567", "5551234567", "+44 20 7946 0958"], "string", tx.normalize_handle)
    assert got == ["alice@example.com", "5551234567", "5551234567", "5551234567", "442079460958"]


def test_text_stats_and_emojis(spark):
    df = spark.createDataFrame([("hello there world",), ("lol 😂😂 nice 🎉",), (None,), ("",)], "t string")
    rows = [tuple(r) for r in df.select(*[c for c in tx.text_stats(F.col("t")).values()]).collect()]
    assert rows[0] == (17, 3, 0) and rows[1][1:] == (4, 3) and rows[2] == rows[3] == (0, 0, 0)
    assert column(spark, ["😂 ok 😂🎉", "👨‍👩‍👧 👍🏽 🇫🇷 1️⃣"], "string", tx.emojis) == [["😂", "😂", "🎉"], ["👨‍👩‍👧", "👍🏽", "🇫🇷", "1️⃣"]]


def test_tokens_and_ngrams(spark):
    assert column(spark, ["Don’t WORRY bro"], "string", tx.found_words) == [["don't", "worry", "bro"]]
    got = column(spark, ["hi there friend", "one", ""], "string", lambda c: tx.ngrams(tx.found_words(c)))
    assert got == [["hi there", "there friend", "hi there friend"], [], []]


def test_contains_word(spark):
    assert column(spark, ["The c.t sat", "cat", "it’s"], "string", lambda c: tx.contains_word(c, "c.t")) == [True, False, False]
    assert column(spark, ["It’s on"], "string", lambda c: tx.contains_word(c, "it's")) == [True]


def test_reaction_target(spark):
    assert column(spark, ["p:0/ABC-123", "bp:DEF-456", None], "string", tx.strip_target) == ["ABC-123", "DEF-456", ""]


def test_bucket_rejects_unknown_unit():
    with pytest.raises(ValueError):
        tf.bucket("year", None)
