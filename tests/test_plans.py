"""Plans stay small: an expression that is used often is bound once."""

import re

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import dates, hours, tagging

#: Regex nodes that the patterns of each rule need, once each.
MOST = {"parse_date": (dates.parse_date, 45), "birth_date": (lambda v: dates.birth_date(v, F.lit("2020-01-01").cast("date")), 30), "working_hours": (hours.working_hours, 15), "address_parts": (tagging.address_parts, 40)}


@pytest.mark.parametrize("name", MOST)
def test_rules_name_each_pattern_once(spark, name):
    rule, most = MOST[name]
    frame = spark.range(1).select(rule(F.concat(F.col("id").cast("string"), F.lit(" x"))).alias("r"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"(?i)\bRLIKE\b|regexp_\w+\(|\bsplit\(", plan)) <= most and len(plan) < 25_000
