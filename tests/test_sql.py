"""The functions that SQL gets."""

from __future__ import annotations

import pytest

from corpuswright.functions import text as T
from corpuswright.functions.rules import JA
from corpuswright.functions.sql import register_functions


@pytest.fixture(scope="module")
def sql(spark):
    register_functions(spark)
    return spark.sql


def test_scalars_equal_the_column_functions(spark, sql):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("あい。う、\nえ！ ![a](b) [c](d) `e` **f** <b>g</b>　h",), ("きょう",), ("",), (None,)], "t string")
    want = df.select(T.solid_length(F.col("t")), T.mora(F.col("t")), T.clean_inline(F.col("t")), T.sentences(F.col("t"), JA)).collect()
    got = sql("SELECT solid_length(t), mora(t), clean_inline(t), sentences_of(t, '。！？!?', '、，') FROM {df}", df=df).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert sql("SELECT per_thousand(3, 0) IS NULL, full_weight(15)").first()[:] == (True, 0.5)


def test_table_functions(sql):
    text = "# h\\n```py\\na\\nb\\n```\\n| x | y |\\n|---|:-:|\\n| 1 | 2 |\\n```\\nopen"
    assert [tuple(r) for r in sql(f"SELECT block, lang, code, n_lines FROM md_code('{text}')").collect()] == [(1, "py", "a\nb", 2)]
    assert [tuple(r) for r in sql(f"SELECT pos, cell, text FROM md_cells('{text}')").collect()] == [(5, 0, "x"), (5, 1, "y"), (7, 0, "1"), (7, 1, "2")]
    assert sql(f"SELECT count(*) FROM md_lines('{text}')").first()[0] == 10
    assert sql("SELECT count(*) FROM md_lines(CAST(NULL AS STRING))").first()[0] == 0


def test_patterns_are_the_callers(spark, sql):
    df = spark.createDataFrame([("a1 b22",), (None,)], "t string")
    got = sql("""SELECT p.* FROM {df}, LATERAL pattern_counts(t, '{{"digits": "[0-9]", "runs": "[0-9]+"}}') AS p""", df=df)
    assert got.columns == ["digits", "runs"]
    assert sorted(map(tuple, got.collect())) == [(0, 0), (3, 2)]
    with pytest.raises(Exception, match="constant JSON"):
        sql("SELECT * FROM {df}, LATERAL pattern_counts(t, t) AS p", df=df).collect()
