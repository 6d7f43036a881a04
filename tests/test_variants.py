import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import variants

TEXTS = [
    ("3", "3"), ("3.0", "3"), ("-1.50", "-1.5"), ("-0", "0"), ("0.0", "0"),
    ("1e2", "100"), ("1e20", "100000000000000000000"), ("1e21", "1e+21"),
    ("1.25e25", "1.25e+25"), ("1e-6", "0.000001"), ("1e-7", "1e-7"),
    ("-0.00001234", "-0.00001234"), ("9007199254740993", "9007199254740992"),
    ("123456789012345678901234", "1.2345678901234569e+23"), ("1e400", "Infinity"),
    ("-1e400", "-Infinity"), ('"x"', "x"), ("true", "true"), ("{}", "[object Object]"),
    ("[]", ""), ("[null]", ""), ("[[],1]", ",1"),
    ('[1,[2,[3,null]],[],{"a":[1]},"q[",true,[[]]]', "1,2,3,,,[object Object],q[,true,"),
]


@pytest.fixture(scope="module")
def texts(spark):
    frame = spark.createDataFrame([(json,) for json, _ in TEXTS], "json string")
    parsed = frame.withColumn("value", F.try_parse_json("json"))
    rows = parsed.select("json", variants.value_text("value").alias("text")).collect()
    return {row["json"]: row["text"] for row in rows}


@pytest.mark.parametrize("json, text", TEXTS)
def test_value_text(texts, json, text):
    assert texts[json] == text


STORED = ['3', '3.0', '"3"', '"3.0"', '7', '"007"', '10000000000', '"1e10"', '1e21', '1e-7',
          '0.1', 'true', '"true"', 'false', '""', '"  "', 'null', '-0', '9007199254740993']
# value asked for -> stored values that read as it
MATCHES = {
    "3": ["3", "3.0", '"3"'],
    "3.0": ['"3.0"'],
    "03": [],
    "007": ['"007"'],
    "7": ["7"],
    "1e10": ['"1e10"'],
    "10000000000": ["10000000000"],
    "1e+21": ["1e21"],
    "1e-7": ["1e-7"],
    "0.1": ["0.1"],
    "true": ["true", '"true"'],
    "false": ["false"],
    "": ['""'],
    "  ": ['"  "'],
    "0": ["-0"],
    "-0": [],
    "9007199254740992": ["9007199254740993"],
    "9007199254740993": [],
    "Infinity": ["null"],
    "NaN": [],
    "null": [],
}


@pytest.mark.parametrize("key", ["k", "a.b", "__proto__", "constructor", "it's", 'say "hi"', "it's \"it\"", "a[0]", "$", "ключ"])
def test_equals_text(spark, key):
    import json

    bodies = [(json.dumps(key) + ":" + value, value) for value in STORED]
    bodies.append(('"other":3', "absent"))
    frame = spark.createDataFrame([(f"{{{b}}}", v) for b, v in bodies], "body string, value string")
    frame = frame.withColumn("attributes", F.parse_json("body"))
    wanted = MATCHES if key == "k" else {"3": MATCHES["3"], "": MATCHES[""]}
    found = frame.select(
        "value",
        *[
            variants.equals_text(F.col("attributes"), key, text).alias(f"c{n}")
            for n, text in enumerate(wanted)
        ],
    ).collect()
    for n, (text, expected) in enumerate(wanted.items()):
        assert [row["value"] for row in found if row[f"c{n}"]] == expected, text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_on_driver_reads_back(number):
    text = variants._driver_number_text(number)
    assert float(text) == number
    assert variants.exact_number(text) == number


def test_wide_and_deep_values_stay_quick(spark):
    import time

    wide = "[" + ",".join(["[]"] * 200_000) + "]"
    deep = "[" * 400 + "]" * 400
    inside = '["' + "[" * 5000 + '"]'
    frame = spark.createDataFrame([(text,) for text in (wide, deep, inside)], "json string")
    begin = time.monotonic()
    rows = frame.select(F.try_parse_json("json").alias("v")).select(
        F.length(variants.value_text("v")).alias("size")
    )
    assert [row["size"] for row in rows.collect()] == [199_999, 0, 5000]
    assert time.monotonic() - begin < 30
