from datetime import date

import pytest

from gridmill.names import BUILDING, NMI, SUBMETER
from gridmill.operators.reconcile import reconcile_daily, reconcile_monthly

from helpers import DAILY, values

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def daily(spark, *rows):
    return spark.createDataFrame([(1, source, day, float(load), 1, 1) for source, day, load in rows], DAILY)


def test_difference_and_ratio(spark):
    result = reconcile_daily(daily(spark, (NMI, D1, 100), (BUILDING, D1, 80), (SUBMETER, D1, 70)))
    assert values(result) == [(1, D1, 100.0, 80.0, 20.0, 0.2)]


def test_one_sided_and_zero_days(spark):
    result = reconcile_daily(daily(spark, (NMI, D1, 100), (BUILDING, D2, 80), (NMI, D3, 0), (BUILDING, D3, 5)))
    assert values(result) == [
        (1, D1, 100.0, None, None, None), (1, D2, None, 80.0, None, None), (1, D3, 0.0, 5.0, -5.0, None),
    ]


def test_only_submeters_give_no_row(spark):
    assert values(reconcile_daily(daily(spark, (SUBMETER, D1, 70)))) == []


def test_monthly_takes_the_ratio_again(spark):
    result = reconcile_monthly(
        reconcile_daily(daily(spark, (NMI, D1, 100), (BUILDING, D1, 80), (NMI, D2, 300), (BUILDING, D3, 20)))
    )
    (row,) = values(result)
    assert row[:5] == (1, D1, 400.0, 100.0, 300.0)
    assert row[5] == pytest.approx(0.75)
