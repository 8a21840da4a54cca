"""Times as text and as numbers, in two session zones."""

import pytest
from pyspark.sql import functions as F

from gridmill.functions import utc_from_nanoseconds, utc_from_text

from helpers import at

FORMS = {
    "2024-01-01 00:00:00": "2024-01-01 00:00",
    "2024-01-01T05:07": "2024-01-01 05:07",
    "2024-01-01": "2024-01-01 00:00",
    " 2024-1-1 5:07:08.5 ": "2024-01-01 05:07:08.500",
    "2024-01-01 00:00:00+10": "2023-12-31 14:00",
    "2024-01-01 00:00:00+1000": "2023-12-31 14:00",
    "2024-01-01T00:00+10:00": "2023-12-31 14:00",
    "2024-01-01T00:00:00.250-03:30": "2024-01-01 03:30:00.250",
    "2024-01-01T00:00:00Z": "2024-01-01 00:00",
    "2024-01-01 00:00:00 UTC": "2024-01-01 00:00",
    "2024-01-01 00:00:00 Australia/Melbourne": "2023-12-31 13:00",
    "2024-01-01 00:00:00 Nowhere/Else": None,
    "2024-13-01": None,
    "12:30": None,
    "2024": None,
    "soon": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "Australia/Melbourne"])
def test_text_times(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in FORMS], "t string")
        found = {r.t: r.utc for r in df.select("t", utc_from_text(F.col("t")).alias("utc")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {text: want and at(want) for text, want in FORMS.items()}


def test_nanoseconds_are_exact(spark):
    start = 1_704_067_200_000_000
    df = spark.range(start, start + 2000).select(
        F.unix_micros(utc_from_nanoseconds(F.col("id") * 1000 + 999).cast("timestamp_ltz")).alias("micros"), "id"
    )
    assert df.where("micros <> id").count() == 0
