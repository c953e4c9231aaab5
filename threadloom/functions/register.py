"""The library's functions by name, for ad-hoc SQL in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import _html_text

#: Scalar functions in SQL, which the planner inlines; name, arguments and body.
SCALARS = {
    "sanitized": ("t STRING", "regexp_replace(t, r'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '')"),
    "truncated": ("t STRING, n INT", "CASE WHEN length(t) > n THEN concat(left(t, n), '...') ELSE t END"),
    "tag_folded": ("t STRING", "translate(t, '․‧·._', '-----')"),
    "month_bin": ("at TIMESTAMP", "greatest(0, (year(at) - 2018) * 12 + month(at) - 1)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes them temporary functions of the session; returns their names."""
    for name, (arguments, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {'INT' if name == 'month_bin' else 'STRING'} RETURN {body}")
    spark.udf.register("html_text", _html_text)
    return [*SCALARS, "html_text"]
