from datetime import date

import pytest

from gridmill.names import BUILDING, NMI
from gridmill.operators.emissions import (
    emissions_match_stats,
    emissions_monthly,
    emissions_monthly_stats,
    emissions_time_varying,
)
from gridmill.sources.reference import (
    grid_intensity_problems,
    load_emissions_factors,
    load_grid_intensity,
    parse_grid_intensity,
    register_reference,
)

from helpers import MONTHLY, at, hourly_frame, values

FACTOR_HEADER = (
    "factor_id,country,region,source_system,energy_type,factor_year,emissions_factor_kg_co2e_per_kwh,"
    "factor_source_name,factor_source_url,is_default,notes"
)
INTENSITY_HEADER = (
    "region_code,region_name,interval_start,interval_end,emissions_intensity_kg_co2e_per_kwh,"
    "source_name,source_url,data_version,notes"
)
DEFAULT = "any_meter,Australia,Tasmania,*,electricity,2024,0.62,State tables,,true,where nothing else fits"
SPECIFIC = f"rooms,Australia,Queensland,{BUILDING},electricity,2024,0.31,State tables,,false,rooms only"


def write_csv(path, header, *rows):
    path.write_text("\n".join((header, *rows)) + "\n", encoding="utf-8")
    return str(path)


def monthly(spark, *rows):
    return spark.createDataFrame(list(rows) or [(1, BUILDING, date(2024, 1, 1), 100.0, 4, 1)], MONTHLY)


def factors(spark, tmp_path, *rows):
    return load_emissions_factors(spark, write_csv(tmp_path / "factors.csv", FACTOR_HEADER, *rows))


def chosen(spark, tmp_path, *rows, usage=None):
    result = emissions_monthly(usage or monthly(spark), factors(spark, tmp_path, *rows))
    return values(result, "factor_id", "used_default_factor", "estimated_emissions_kg_co2e")


def test_factor_file_needs_its_columns(spark, tmp_path):
    path = write_csv(tmp_path / "bad.csv", "factor_id,country", "bad,Australia")
    with pytest.raises(ValueError, match="no column"):
        load_emissions_factors(spark, path)


def test_factor_file_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_emissions_factors(spark, str(tmp_path / "none.csv"))


def test_factor_file_rejects_text_for_numbers(spark, tmp_path):
    with pytest.raises(ValueError, match="is no number"):
        factors(spark, tmp_path, DEFAULT.replace("2024", "soon"))


def test_factor_types_and_blanks(spark, tmp_path):
    rows = [DEFAULT.replace(",true,", f",{flag},").replace("any_meter", flag) for flag in ("TRUE", "1", "Yes", "no", "0")]
    loaded = factors(spark, tmp_path, *rows)
    assert dict(values(loaded, "factor_id", "is_default")) == {
        "TRUE": True, "1": True, "Yes": True, "no": False, "0": False,
    }
    assert set(values(loaded, "factor_year", "factor_source_url")) == {(2024, "")}


def test_specific_factor_beats_wildcard(spark, tmp_path):
    assert chosen(spark, tmp_path, DEFAULT, SPECIFIC) == [("rooms", False, 31.0)]


def test_default_is_the_fallback(spark, tmp_path):
    assert chosen(spark, tmp_path, DEFAULT) == [("any_meter", True, 62.0)]


def test_default_of_a_later_year_is_allowed(spark, tmp_path):
    assert chosen(spark, tmp_path, DEFAULT.replace("2024", "2026")) == [("any_meter", True, 62.0)]


def test_specific_factor_of_a_later_year_is_not(spark, tmp_path):
    assert chosen(spark, tmp_path, SPECIFIC.replace("2024", "2026")) == []


def test_exact_year_then_not_default_then_newest(spark, tmp_path):
    def row(name, year, default):
        return SPECIFIC.replace("rooms", name).replace("2024", str(year)).replace("false", default)

    old, newer = row("old", 2020, "false"), row("newer", 2022, "false")
    assert chosen(spark, tmp_path, old, newer)[0][0] == "newer"
    assert chosen(spark, tmp_path, old, newer, row("default", 2023, "true"))[0][0] == "newer"
    assert chosen(spark, tmp_path, newer, row("exact", 2024, "true"))[0][0] == "exact"
    assert chosen(spark, tmp_path, row("b", 2022, "false"), row("a", 2022, "false"))[0][0] == "a"


def test_other_country_and_energy_do_not_count(spark, tmp_path):
    rows = (DEFAULT.replace(",Australia,", ",Norway,", 1), DEFAULT.replace("electricity", "gas"))
    assert chosen(spark, tmp_path, *rows) == []


def test_many_factors_keep_one_row_per_usage_row(spark, tmp_path):
    usage = monthly(
        spark, *[(c, s, date(y, m, 1), 10.0, 1, 1) for c in (1, 2) for s in (BUILDING, NMI) for y in (2023, 2024) for m in (1, 2)]
    )
    rows = [DEFAULT.replace("any_meter", f"d{y}").replace("2024", str(y)) for y in range(2018, 2027)] + [SPECIFIC]
    result = emissions_monthly(usage, factors(spark, tmp_path, *rows))
    assert result.count() == usage.count()
    picked = {(r.source_system, r.usage_month.year): r.factor_id for r in result.collect()}
    assert picked == {
        (BUILDING, 2023): "d2023", (BUILDING, 2024): "rooms", (NMI, 2023): "d2023", (NMI, 2024): "d2024",
    }


def test_monthly_stats(spark, tmp_path):
    loaded = factors(spark, tmp_path, DEFAULT, SPECIFIC)
    built = emissions_monthly(monthly(spark, (1, BUILDING, date(2024, 1, 1), 1.0, 1, 1), (1, NMI, date(2024, 1, 1), 1.0, 1, 1)), loaded)
    assert values(emissions_monthly_stats(built, loaded)) == [(2, 2, 1)]


# grid intensity

HOUR_8 = "QLD1,Queensland,2024-01-01 08:00:00,2024-01-01 09:00:00,0.73,Synthetic market,,v3,made up"


def intensity(spark, tmp_path, *rows):
    return load_grid_intensity(spark, write_csv(tmp_path / "intensity.csv", INTENSITY_HEADER, *rows))


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ((HOUR_8.replace("0.73", "-0.10"),), "negative_intensity 1"),
        ((HOUR_8.replace("0.73", "lots"),), "null_intensity 1"),
        ((HOUR_8.replace("2024-01-01 08:00:00", "soon"),), "null_interval_start 1"),
        ((HOUR_8.replace("2024-01-01 09:00:00", ""),), "null_interval_end 1"),
        ((HOUR_8, HOUR_8.replace("08:00:00", "08:15:00")), "duplicate_region_hours 1"),
        ((), "no rows"),
    ],
)
def test_intensity_file_is_checked(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        intensity(spark, tmp_path, *rows)


def test_intensity_file_needs_its_columns(spark, tmp_path):
    path = write_csv(tmp_path / "bad.csv", "region_code,region_name", "VIC1,Victoria")
    with pytest.raises(ValueError, match="no column"):
        load_grid_intensity(spark, path)


def test_intensity_times_are_utc_and_synthetic_is_seen(spark, tmp_path):
    rows = (
        HOUR_8.replace("08:00:00", "08:20:30"),
        "NSW1,NSW,2024-01-01T18:15:00+10:00,2024-01-01T09:00:00Z,0.5,Feed,,1,plain",
    )
    loaded = intensity(spark, tmp_path, *rows)
    picked = values(loaded, "region_code", "interval_start", "interval_end", "interval_start_hour", "is_synthetic")
    assert picked == [
        ("NSW1", at("2024-01-01 08:15"), at("2024-01-01 09:00"), at("2024-01-01 08:00"), False),
        ("QLD1", at("2024-01-01 08:20:30"), at("2024-01-01 09:00"), at("2024-01-01 08:00"), True),
    ]


def test_intensity_offsets_do_not_depend_on_the_session_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Melbourne")
    try:
        test_intensity_times_are_utc_and_synthetic_is_seen(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_problem_counts(spark):
    names = INTENSITY_HEADER.split(",")
    good = HOUR_8.split(",")
    rows = [good, good, good[:4] + ["x"] + good[5:], good[:2] + ["y", "z", "-1"] + good[5:]]
    raw = spark.createDataFrame(rows, names)
    assert values(grid_intensity_problems(parse_grid_intensity(raw))) == [(4, 1, 1, 1, 1, 1)]


def static_emissions(spark, tmp_path):
    usage = monthly(spark, (1, BUILDING, date(2024, 1, 1), 150.0, 4, 1))
    return emissions_monthly(usage, factors(spark, tmp_path, DEFAULT))


def test_time_varying_matches_and_falls_back(spark, tmp_path):
    hourly = hourly_frame(spark, {"2024-01-01 08:00": 100, "2024-01-01 09:00": 50})
    other_region = HOUR_8.replace("QLD1", "NSW1").replace("08:00:00", "09:00:00")
    by_hour = intensity(spark, tmp_path, HOUR_8, other_region)
    result = emissions_time_varying(hourly, static_emissions(spark, tmp_path), by_hour, "QLD1")
    rows = values(
        result, "usage_hour", "static_estimated_emissions_kg_co2e",
        "time_varying_estimated_emissions_kg_co2e", "factor_match_status", "factor_source_name",
    )
    assert [row[1:] for row in rows] == [
        (62.0, 73.0, "matched_hourly_factor", "Synthetic market"),
        (31.0, None, "fallback_static_factor", "State tables"),
    ]
    assert values(emissions_match_stats(result, by_hour)) == [(2, 2, 1, 1, 0)]


def test_time_varying_without_an_intensity_file(spark, tmp_path):
    hourly = hourly_frame(spark, {"2024-01-01 08:00": 100, "2024-01-01 09:00": 50, "2024-02-01 09:00": 5})
    none = load_grid_intensity(spark, str(tmp_path / "missing.csv"))
    result = emissions_time_varying(hourly, static_emissions(spark, tmp_path), none)
    assert values(emissions_match_stats(result, none)) == [(0, 3, 0, 2, 1)]


def test_registered_intensity_has_a_load_time(spark, tmp_path):
    stored = register_reference(intensity(spark, tmp_path, HOUR_8), "reference_test_intensity", stamp=True)
    assert stored.where("ingested_at IS NOT NULL").count() == 1
