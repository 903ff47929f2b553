import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import canon as cn
from twinframe.functions import text as tx
from twinframe.functions import types as ty


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluated(spark, values, kind, expression):
    df = column(spark, values, kind)
    return [r.x for r in df.select("i", F.expr(expression("v", df.schema["v"].dataType)).alias("x")).orderBy("i").collect()]


def number_of(text):
    """What a text means as a number, or None."""
    bare = text.strip()
    if re.fullmatch(r"[+-]?[0-9]+", bare):
        return int(bare)
    return float(bare) if re.fullmatch(r"[+-]?[0-9]+\.[0-9]*", bare) else None


def same(a, b):
    """Equality of two texts by the rules of value comparison."""
    if a is None or b is None:
        return a is b
    left, right = number_of(a), number_of(b)
    if left is None and right is None:
        return a.strip() == b.strip()
    return left == right and left is not None and right is not None


SPELLINGS = [
    " 12 ", "12", "+012", "12.", "12.0", "12.50", "12.5", "-0", "0", "0.0", "-0.0", ".5", "1e5", "100000", "abc",
    "ABC", " abc ", "", "  ", None, "9" * 40, "0" + "9" * 40, "18446744073709551616", "18446744073709551616.0",
    "1152921504606846976.0", "1152921504606846976", "1.1", "01.10", "+1.1", "1,1", "NaN", "null", "1.0\n", "　1",
]


def test_canon_agrees_with_the_rules_for_every_pair(spark):
    canonical = evaluated(spark, SPELLINGS, "string", lambda x, t: cn.canon(x, t))
    for a, x in zip(SPELLINGS, canonical):
        for b, y in zip(SPELLINGS, canonical):
            assert (x == y) == same(a, b), (a, x, b, y)


def test_canon_of_random_numbers(spark):
    draw = random.Random(7)
    values = []
    for _ in range(500):
        whole = str(draw.randrange(10 ** draw.randrange(1, 25)))
        tail = draw.choice(["", ".", f".{draw.randrange(100)}", ".0", ".50"])
        values.append(draw.choice(["", "+", "-", " "]) + draw.choice(["", "0", "00"]) + whole + tail)
    canonical = evaluated(spark, values, "string", lambda x, t: cn.canon(x, t))
    for _ in range(20000):
        i, j = draw.randrange(500), draw.randrange(500)
        assert (canonical[i] == canonical[j]) == same(values[i], values[j])


@pytest.mark.parametrize(
    "kind, value, text",
    [
        ("int", 12, "12.0"),
        ("double", 12.0, "012"),
        ("double", 1.1, "1.10"),
        ("float", 0.1, "0.1"),
        ("boolean", True, "1"),
        ("boolean", False, "0"),
        ("binary", bytearray(b"12"), "12"),
        ("double", 2.0**63, str(2**63)),
        ("double", 1.2345678901234567e30, str(int(1.2345678901234567e30))),
        ("double", -(2.0**70), str(-(2**70))),
    ],
)
def test_canon_of_typed_values_meets_text(spark, kind, value, text):
    typed = evaluated(spark, [value], kind, lambda x, t: cn.canon(x, t))
    assert typed == evaluated(spark, [text], "string", lambda x, t: cn.canon(x, t))


def test_canon_of_decimals_and_missing(spark):
    df = spark.sql("SELECT CAST('1.10' AS DECIMAL(10,2)) AS a, CAST('7.00' AS DECIMAL(10,2)) AS b, double('NaN') AS c")
    a, b, c = df.select(*[F.expr(cn.canon(n, df.schema[n].dataType)) for n in "abc"]).first()
    assert (a, b, c) == ("n:1.1", "n:7", None)


def test_values_equal_is_never_null_and_folds_nan(spark):
    df = spark.sql("SELECT * FROM VALUES (double('NaN'), CAST(NULL AS DOUBLE)), (1D, NULL), (0D, -0D) AS v(a, b)")
    t = T.DoubleType()
    assert [r[0] for r in df.select(F.expr(cn.values_equal("a", "b", t, t))).collect()] == [True, False, True]


def test_float_text_is_the_shortest(spark):
    draw = random.Random(3)
    values = [0.0, 1e7, 1e16, 1e-4, 1e-5, 123456789.25, 2e-3, 1e22, 1.7e308, -1e7, 7.1519210000000008e16]
    values += [draw.uniform(-1, 1) * 10 ** draw.randrange(-20, 25) for _ in range(2000)]
    assert evaluated(spark, values, "double", lambda x, t: tx.float_text(x)) == [repr(v) for v in values]


def test_quoted_text(spark):
    values = ["a", "it's", 'say "x"', "it's \"x\"", "tab\there", "line\nend", "back\\slash", "é"]
    assert evaluated(spark, values, "string", lambda x, t: tx.display(x, t)) == [repr(v) for v in values]


def test_display_of_typed_values(spark):
    row = spark.sql(
        "SELECT DATE'2024-01-02' AS a, TIMESTAMP_NTZ'2024-01-02 03:04:05.5' AS b, 1.10BD AS c, true AS d, "
        "CAST(NULL AS INT) AS e, array(1, 2) AS f, map('b', 1, 'a', 2) AS g"
    )
    shown = row.select(*[F.expr(tx.display(f.name, f.dataType)) for f in row.schema.fields]).first()
    assert shown[0] == "datetime.date(2024, 1, 2)"
    assert shown[1] == "Timestamp('2024-01-02 03:04:05.500000')"
    assert shown[2:6] == ("Decimal('1.10')", "True", "None", "[1,2]")
    assert shown[6].index('"a"') < shown[6].index('"b"')


def test_short_names(spark):
    assert evaluated(spark, ["  Sales / Été 2024! "], "string", lambda x, t: tx.slug(x)) == ["sales_été_2024"]
    assert evaluated(spark, ["abcdefgh", "abc"], "string", lambda x, t: tx.truncated(x, 6)) == ["abc...", "abc"]
    assert evaluated(spark, ["#abc", "red"], "string", lambda x, t: tx.colour_text(x)) == ["#ABC", "red"]
    assert tx.report_name("My Run / 1") == "my_run___1"


def test_zero_rules(spark):
    assert evaluated(spark, ["0100", "100", "a0"], "string", lambda x, t: tx.drop_first_zero(x)) == ["100", "10", "a"]
    assert evaluated(spark, ["00123", "0"], "string", lambda x, t: tx.drop_leading_zeros(x)) == ["123", "0"]


def test_type_families():
    assert ty.compatible(T.IntegerType(), T.DecimalType(10, 2))
    assert ty.compatible(T.DateType(), T.TimestampNTZType())
    assert not ty.compatible(T.StringType(), T.LongType())
    assert not ty.compatible(T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    field = T.StructField("a", T.StringType(), True, {"__CHAR_VARCHAR_TYPE_STRING": "varchar(12)"})
    assert ty.declared_length(field) == 12
