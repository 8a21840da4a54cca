"""SQL counterparts of the registered queries, for DuckDB over the raw test tables.

Each is written against shared common table expressions that rebuild the layers from
``events``, ``supplier``, ``region``, ``documents`` and ``pages``.
"""

from __future__ import annotations

from event_feed import TABLE_SCHEMAS
from gridmill.functions.text import STOPWORDS

LAYERS = r"""
spread_events AS (
  SELECT * REPLACE (ts + to_months(CAST(CASE WHEN event_id % 11 = 0 THEN -114 WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 12 = 3 THEN 2 ELSE 0 END AS INTEGER)) AS ts)
  FROM events
),
bronze_building AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 + (user_id >> 1) % 5 END AS campus_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS meter_id,
         time_bucket(INTERVAL '15 minutes', ts) AS "timestamp",
         CASE WHEN event_id % 97 <> 0 THEN round(value * 100) - 100 END AS consumption
  FROM spread_events WHERE event_type IN ('view', 'signup')
),
bronze_nmi AS (
  SELECT CASE WHEN event_id % 101 = 0 THEN 'N/A' ELSE CAST(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 + (user_id >> 1) % 5 END AS VARCHAR) END AS campus_id,
         CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS meter_id, time_bucket(INTERVAL '15 minutes', ts) AS "timestamp",
         CASE WHEN event_id % 97 <> 0 THEN round(value * 100) - 100 END AS consumption
  FROM spread_events WHERE event_type = 'purchase'
),
bronze_submeter AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 + (user_id >> 1) % 5 END AS campus_id, user_id % 8 AS building_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS id,
         time_bucket(INTERVAL '15 minutes', ts) AS "timestamp",
         CASE WHEN event_id % 97 <> 0 THEN round(value * 100) - 100 END AS consumption,
         value / 240 AS "current", value AS power
  FROM spread_events WHERE event_type = 'click'
),
bronze_weather AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 + (user_id >> 1) % 5 END AS campus_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM spread_events WHERE event_type = 'error'
),
building AS (
  SELECT campus_id, meter_id, "timestamp" AS reading_timestamp, consumption,
         'building_consumption' AS source_system
  FROM bronze_building WHERE consumption >= 0
  QUALIFY row_number() OVER (PARTITION BY campus_id, meter_id, "timestamp" ORDER BY consumption) = 1
),
nmi AS (
  SELECT TRY_CAST(campus_id AS BIGINT) AS campus_id, meter_id, "timestamp" AS reading_timestamp, consumption,
         consumption * 4 AS demand_kw, consumption * CAST(4.2 AS DOUBLE) AS demand_kva,
         'nmi_consumption' AS source_system
  FROM bronze_nmi WHERE consumption >= 0 AND TRY_CAST(campus_id AS BIGINT) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY campus_id, meter_id, "timestamp" ORDER BY consumption) = 1
),
submeter AS (
  SELECT campus_id, building_id, id AS meter_id, "timestamp" AS reading_timestamp, consumption, "current",
         CAST(240.0 AS DOUBLE) AS voltage, power, CAST(0.95 AS DOUBLE) AS power_factor,
         'building_submeter_consumption' AS source_system
  FROM bronze_submeter WHERE consumption >= 0
  QUALIFY row_number() OVER (
    PARTITION BY campus_id, building_id, id, "timestamp" ORDER BY consumption, power, "current") = 1
),
readings AS (
  SELECT campus_id, source_system, meter_id, CAST(NULL AS BIGINT) AS building_id, reading_timestamp, consumption
  FROM building
  UNION ALL SELECT campus_id, source_system, meter_id, NULL, reading_timestamp, consumption FROM nmi
  UNION ALL SELECT campus_id, source_system, meter_id, building_id, reading_timestamp, consumption FROM submeter
),
hourly AS (
  SELECT campus_id, source_system, meter_id, building_id, date_trunc('hour', reading_timestamp) AS usage_hour,
         sum(consumption) AS total_consumption, count(*) AS reading_count,
         min(reading_timestamp) AS first_reading_timestamp, max(reading_timestamp) AS last_reading_timestamp
  FROM readings GROUP BY ALL
),
daily AS (
  SELECT campus_id, source_system, CAST(usage_hour AS DATE) AS usage_date,
         sum(total_consumption) AS total_consumption, CAST(sum(reading_count) AS BIGINT) AS reading_count,
         count(DISTINCT meter_id) AS meter_count
  FROM hourly GROUP BY ALL
),
monthly AS (
  SELECT campus_id, source_system, CAST(date_trunc('month', usage_date) AS DATE) AS usage_month,
         sum(total_consumption) AS total_consumption, CAST(sum(reading_count) AS BIGINT) AS reading_count,
         max(meter_count) AS max_daily_meter_count
  FROM daily GROUP BY ALL
),
peaks AS (
  SELECT campus_id, meter_id, reading_timestamp AS peak_timestamp, demand_kw AS peak_demand_kw,
         demand_kva AS peak_demand_kva, consumption AS consumption_at_peak
  FROM nmi
  QUALIFY row_number() OVER (
    PARTITION BY campus_id, meter_id ORDER BY demand_kw DESC, reading_timestamp) = 1
),
factors AS (
  SELECT 'factor_' || s_suppkey AS factor_id,
         CASE WHEN s_nationkey < 20 THEN 'Australia' ELSE 'New Zealand' END AS country,
         'region_' || s_nationkey AS region,
         CASE s_suppkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'building_consumption' ELSE 'nmi_consumption' END
           AS source_system,
         CASE WHEN s_suppkey % 5 = 0 THEN 'gas' ELSE 'electricity' END AS energy_type,
         CAST(2015 + s_suppkey % 15 AS INTEGER) AS factor_year,
         CAST('0.' || (20 + s_suppkey % 60) AS DOUBLE) AS emissions_factor_kg_co2e_per_kwh,
         s_name AS factor_source_name, '' AS factor_source_url,
         s_suppkey % 3 <> 0 AND s_suppkey % 7 IN (0, 2, 4) AS is_default, 'Factor of ' || s_name AS notes
  FROM supplier
),
emissions AS (
  SELECT m.campus_id, m.source_system, m.usage_month, m.total_consumption, f.factor_id,
         f.country AS factor_country, f.region AS factor_region, f.energy_type, f.factor_year,
         f.emissions_factor_kg_co2e_per_kwh, f.factor_source_name, f.factor_source_url,
         f.is_default AS used_default_factor, f.notes AS factor_notes,
         m.total_consumption * f.emissions_factor_kg_co2e_per_kwh AS estimated_emissions_kg_co2e
  FROM monthly m JOIN factors f
    ON f.energy_type = 'electricity' AND f.country = 'Australia'
   AND (f.factor_year <= year(m.usage_month) OR f.is_default)
   AND f.source_system IN (m.source_system, '*')
  QUALIFY row_number() OVER (
    PARTITION BY m.campus_id, m.source_system, m.usage_month
    ORDER BY CASE WHEN f.source_system = m.source_system THEN 0 ELSE 1 END,
             CASE WHEN f.factor_year = year(m.usage_month) THEN 0 ELSE 1 END,
             f.is_default, f.factor_year DESC, f.factor_id) = 1
),
station_hours AS (
  SELECT CASE WHEN user_id % 20 = 0 THEN 'VIC1' ELSE 'NSW1' END AS region_code,
         date_trunc('hour', ts) AS "hour", CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM spread_events WHERE event_type = 'error'
),
intensity AS (
  SELECT region_code, CASE region_code WHEN 'VIC1' THEN 'Victoria' ELSE 'New South Wales' END AS region_name,
         "hour" AS interval_start, "hour" + INTERVAL 1 HOUR AS interval_end, "hour" AS interval_start_hour,
         CAST('0.' || (10 + min(k) % 80) AS DOUBLE) AS emissions_intensity_kg_co2e_per_kwh,
         'Grid feed ' || region_code AS source_name, '' AS source_url, '1' AS data_version,
         hour("hour") < 12 AS is_synthetic,
         CASE WHEN hour("hour") < 12 THEN 'Synthetic morning row' ELSE 'Afternoon row' END AS notes
  FROM station_hours GROUP BY region_code, "hour"
),
time_varying AS (
  SELECT h.usage_hour, h.campus_id, h.source_system, h.meter_id, h.building_id, h.total_consumption,
         e.emissions_factor_kg_co2e_per_kwh AS static_emissions_factor_kg_co2e_per_kwh,
         h.total_consumption * e.emissions_factor_kg_co2e_per_kwh AS static_estimated_emissions_kg_co2e,
         i.emissions_intensity_kg_co2e_per_kwh AS time_varying_emissions_factor_kg_co2e_per_kwh,
         h.total_consumption * i.emissions_intensity_kg_co2e_per_kwh
           AS time_varying_estimated_emissions_kg_co2e,
         coalesce(i.source_name, e.factor_source_name) AS factor_source_name,
         coalesce(i.source_url, e.factor_source_url) AS factor_source_url,
         CASE WHEN i.emissions_intensity_kg_co2e_per_kwh IS NOT NULL THEN 'matched_hourly_factor'
              WHEN e.emissions_factor_kg_co2e_per_kwh IS NOT NULL THEN 'fallback_static_factor'
              ELSE 'missing_hourly_factor' END AS factor_match_status
  FROM hourly h
  LEFT JOIN emissions e ON e.campus_id = h.campus_id AND e.source_system = h.source_system
    AND e.usage_month = CAST(date_trunc('month', h.usage_hour) AS DATE)
  LEFT JOIN intensity i ON i.region_code = 'VIC1' AND i.interval_start_hour = h.usage_hour
),
recon_daily AS (
  SELECT *, nmi_consumption - building_consumption AS consumption_difference,
         (nmi_consumption - building_consumption) / nullif(nmi_consumption, 0) AS difference_ratio_to_nmi
  FROM (SELECT campus_id, usage_date,
               sum(total_consumption) FILTER (WHERE source_system = 'nmi_consumption') AS nmi_consumption,
               sum(total_consumption) FILTER (WHERE source_system = 'building_consumption')
                 AS building_consumption
        FROM daily WHERE source_system IN ('nmi_consumption', 'building_consumption') GROUP BY ALL)
),
recon_monthly AS (
  SELECT *, nmi_consumption - building_consumption AS consumption_difference,
         (nmi_consumption - building_consumption) / nullif(nmi_consumption, 0) AS difference_ratio_to_nmi
  FROM (SELECT campus_id, CAST(date_trunc('month', usage_date) AS DATE) AS usage_month,
               sum(nmi_consumption) AS nmi_consumption, sum(building_consumption) AS building_consumption
        FROM recon_daily GROUP BY ALL)
),
weather AS (
  SELECT campus_id, date_trunc('hour', ts) AS usage_hour, avg(15 + k % 10) AS air_temperature,
         avg(14 + k % 10) AS apparent_temperature, avg(k) AS relative_humidity
  FROM bronze_weather WHERE k % 13 <> 0 GROUP BY ALL
),
usage_weather AS (
  SELECT h.campus_id, h.source_system, h.meter_id, h.building_id, h.usage_hour,
         CAST(h.usage_hour AS DATE) AS usage_date, h.total_consumption AS actual_consumption,
         w.air_temperature, w.apparent_temperature, w.relative_humidity,
         CAST(hour(h.usage_hour) AS INTEGER) AS hour_of_day,
         CAST(dayofweek(h.usage_hour) AS INTEGER) AS day_of_week,
         CAST(month(h.usage_hour) AS INTEGER) AS usage_month_number,
         floor(w.air_temperature / 5) * 5 AS temperature_band_c
  FROM hourly h JOIN weather w USING (campus_id, usage_hour)
),
expected AS (
  SELECT *, median(actual_consumption) OVER (
           PARTITION BY campus_id, source_system, meter_id, building_id, hour_of_day, day_of_week,
             usage_month_number, temperature_band_c) AS expected_consumption
  FROM usage_weather
),
residuals AS (
  SELECT *, actual_consumption - expected_consumption AS residual_consumption,
         (actual_consumption - expected_consumption) / nullif(expected_consumption, 0) AS residual_percent
  FROM expected
),
baseline AS (
  SELECT *, 'grouped_median_weather_time_v1' AS baseline_model_version,
         coalesce(residual_percent >= 0.25 AND residual_consumption > 0, FALSE) AS is_high_usage_candidate,
         CASE WHEN residual_percent IS NULL OR residual_consumption <= 0 THEN CAST(0 AS DOUBLE)
              ELSE least(100, round(residual_percent * 100, 2)) END AS efficiency_opportunity_score
  FROM residuals
),
meter_days AS (
  SELECT campus_id, source_system, meter_id, building_id, CAST(usage_hour AS DATE) AS simulation_date,
         first(usage_hour ORDER BY total_consumption DESC, usage_hour) AS peak_hour,
         first(usage_hour ORDER BY total_consumption, usage_hour) AS target_hour,
         sum(total_consumption) AS d, max(total_consumption) AS p, min(total_consumption) AS l
  FROM hourly GROUP BY ALL
),
shifted AS (
  SELECT *, least(p * f, p) AS s, greatest(p - least(p * f, p), l + least(p * f, p)) AS new_peak
  FROM meter_days, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.10 AS DOUBLE)), (CAST(0.15 AS DOUBLE))) v(f)
  WHERE peak_hour <> target_hour AND abs(hour(peak_hour) - hour(target_hour)) <= 4
),
shifts AS (
  SELECT 'peak_shift_' || campus_id || '_' || source_system || '_' || simulation_date || '_' ||
           CAST(round(f * 100) AS INTEGER) AS simulation_id,
         campus_id, source_system, meter_id, building_id, simulation_date,
         'same_day_peak_to_lowest_load' AS shift_strategy, f AS flexible_load_percent, 4 AS max_shift_hours,
         peak_hour, target_hour, d AS baseline_daily_consumption, p AS baseline_peak_consumption,
         l AS baseline_target_consumption, s AS shifted_consumption, new_peak AS simulated_peak_consumption,
         p - new_peak AS peak_reduction,
         CASE WHEN p <> 0 THEN (p - new_peak) / p END AS peak_reduction_percent,
         d - p - l + (p - s) + (l + s) AS simulated_daily_consumption,
         abs(d - (d - p - l + (p - s) + (l + s))) < 0.0001 AS total_energy_preserved,
         p - s < 0 OR l + s < 0 AS negative_usage_created,
         'Hourly consumption is used as a peak-load proxy. Static emissions factor: same-day load shifting preserves total kWh, so estimated emissions are unchanged.' AS notes
  FROM shifted WHERE p - s >= 0 AND l + s >= 0 AND p >= new_peak
),
event_windows AS (
  SELECT campus_id, source_system, meter_id, building_id,
         sum(total_consumption) FILTER (WHERE hour(usage_hour) BETWEEN {start_hour} AND {end_hour} - 1) AS base,
         coalesce(sum(total_consumption) FILTER (
           WHERE hour(usage_hour) BETWEEN {end_hour} AND {end_hour} + 2), 0) AS after
  FROM hourly WHERE CAST(usage_hour AS DATE) = DATE '{event_date}' GROUP BY ALL
),
responses AS (
  SELECT 'demand_response_' || campus_id || '_' || source_system || '_{event_date}_{start_hour}_{end_hour}'
           AS simulation_id,
         campus_id, source_system, meter_id, building_id, DATE '{event_date}' AS event_date,
         {start_hour} AS start_hour, {end_hour} AS end_hour, {end_hour} - {start_hour} AS event_duration_hours,
         t AS target_reduction_percent, f AS flexible_load_percent, 3 AS rebound_window_hours,
         base AS baseline_event_consumption, base - least(base * f, base) AS simulated_event_consumption,
         base * t AS target_reduction, least(base * f, base) AS achieved_reduction,
         greatest(base * t - least(base * f, base), 0) AS unmet_reduction,
         least(base * f, base) >= base * t AS target_met, after AS baseline_rebound_consumption,
         after + least(base * f, base) AS simulated_rebound_consumption,
         after + least(base * f, base) - after AS rebound_load,
         abs((base + after) - (base - least(base * f, base) + after + least(base * f, base))) < 0.0001
           AS total_energy_preserved,
         base - least(base * f, base) < 0 OR after + least(base * f, base) < 0 AS negative_load_created,
         CASE WHEN base * t <> 0 THEN least(base * f, base) / (base * t) END AS target_achievement_ratio,
         CAST(NULL AS DOUBLE) AS estimated_emissions_impact_kg_co2e,
         'No emissions impact is calculated unless real time-varying carbon intensity is loaded.'
           AS emissions_notes,
         'demand_response_peak_only_v1' AS simulation_version,
         'Offline simulation only. This is not real-time control or utility program participation.' AS notes
  FROM event_windows, (VALUES {targets}) settings(t, f) WHERE base > 0
),
checks AS (
  {checks}
)
"""

CHECK = """
  SELECT 'row_count_positive' AS name, 'silver.{table}' AS table_name,
         CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS VARCHAR) AS observed_value,
         '> 0' AS expected, 'Silver table should contain rows after transformation.' AS description FROM {cte}
  UNION ALL
  SELECT 'required_fields_not_null', 'silver.{table}', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END,
         CAST(count(*) AS VARCHAR), '0', 'Required silver fields should not be null.'
  FROM {cte} WHERE {missing}
  UNION ALL
  SELECT 'consumption_non_negative', 'silver.{table}', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END,
         CAST(count(*) AS VARCHAR), '0', 'Consumption should be non-negative in silver.'
  FROM {cte} WHERE consumption < 0
  UNION ALL
  SELECT 'duplicate_key_count', 'silver.{table}', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END,
         CAST(count(*) AS VARCHAR), '0', 'No duplicate records for key: {keys}.'
  FROM (SELECT {keys} FROM {cte} GROUP BY {keys} HAVING count(*) > 1)
  UNION ALL
  SELECT 'timestamp_coverage_present', 'silver.{table}',
         CASE WHEN min(reading_timestamp) IS NOT NULL THEN 'PASS' ELSE 'FAIL' END,
         coalesce(CAST(min(reading_timestamp) AS VARCHAR), 'None') || ' to ' ||
           coalesce(CAST(max(reading_timestamp) AS VARCHAR), 'None'),
         'non-null min and max', 'Timestamp coverage should be present for each silver table.' FROM {cte}
  UNION ALL
  SELECT 'campus_reference_exists', 'silver.{table}', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END,
         CAST(count(*) AS VARCHAR), '0', 'Silver campus IDs should exist in bronze campus metadata.'
  FROM {cte} LEFT JOIN region ON campus_id = r_regionkey WHERE r_regionkey IS NULL"""

# Text shapes: whitespace as the Spark side strips it, then sections and paragraphs by array functions.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STOP = ", ".join(f"'{word}'" for word in STOPWORDS)


def _chunks(name: str, source: str, key: str, separator: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    unified = r"regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
    marked = f"regexp_replace({unified}, '\\n#', chr(1) || '#', 'g')"
    return f"""
{name}_sections AS (
  SELECT {key}, unnest(string_split({marked}, chr(1))) AS section,
         unnest(range(len(string_split({marked}, chr(1))))) AS section_no
  FROM ({source})
),
{name}_parts AS (
  SELECT {key}, section_no,
         CASE WHEN starts_with(section, '#') THEN
           coalesce(nullif({strip("ltrim(string_split(section, chr(10))[1], '#')")}, ''), 'Overview')
         ELSE 'Overview' END AS heading,
         CASE WHEN starts_with(section, '#')
              THEN CASE WHEN contains(section, chr(10)) THEN substr(section, strpos(section, chr(10)) + 1) ELSE '' END
              ELSE section END AS body
  FROM {name}_sections
),
{name} AS (
  SELECT {key}, CAST(section_no AS INTEGER) AS section_no, CAST(paragraph_no AS INTEGER) AS paragraph_no,
         heading, {strip("paragraph")} AS text
  FROM (SELECT {key}, section_no, heading, unnest(string_split_regex(body, '{separator}')) AS paragraph,
               unnest(range(len(string_split_regex(body, '{separator}')))) AS paragraph_no
        FROM {name}_parts)
  WHERE {strip("paragraph")} <> ''
)"""


def _words(text: str) -> str:
    return (
        f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9_]+')), "
        f"lambda w: length(w) > 1 AND w NOT IN ({STOP})))"
    )


PAGE_TEXT = (
    "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h[1-6]>', "
    "chr(10) || '# ', 'g'), '</h[1-6]>', chr(10), 'g'), '<br>|</p>|</div>|</li>', chr(10) || chr(10), 'g'), "
    "'<[^>]*>', '', 'g') AS text FROM pages"
)

HOURLY_COLUMNS = (
    "campus_id bigint, source_system string, meter_id bigint, building_id bigint, usage_hour timestamp_ntz, "
    "total_consumption double, reading_count bigint, first_reading_timestamp timestamp_ntz, "
    "last_reading_timestamp timestamp_ntz"
)
BUILDING_FEED_COLUMNS = "campus_id bigint, meter_id bigint, timestamp timestamp_ntz, consumption double"
LAYER_SOURCES = {
    ("bronze", "bronze_building_consumption"): "bronze_building",
    ("bronze", "bronze_nmi_consumption"): "bronze_nmi",
    ("bronze", "bronze_building_submeter_consumption"): "bronze_submeter",
    ("bronze", "bronze_weather_data"): "bronze_weather",
    ("silver", "silver_building_electricity_readings"): "building",
    ("silver", "silver_nmi_electricity_readings"): "nmi",
    ("silver", "silver_submeter_electricity_readings"): "submeter",
    ("gold", "gold_hourly_electricity_usage"): "hourly",
    ("gold", "gold_daily_electricity_usage"): "daily",
    ("gold", "gold_peak_demand"): "peaks",
    ("reference", "reference_emissions_factors"): "factors",
    ("reference", "reference_grid_carbon_intensity_hourly"): "intensity",
}


def _columns(listed: str) -> list[tuple[str, str]]:
    return [tuple(column.split(" ")) for column in listed.split(", ")]


def _profile(table: str, listed: str, source: str, sample: int = 5) -> str:
    columns = _columns(listed)
    no_time = "CAST(NULL AS TIMESTAMP)"
    bounds = lambda name, kind, f: f'{f}("{name}")' if "time" in name and kind.startswith("time") or "date" in name else no_time

    def shown(name: str, kind: str) -> str:
        if kind.startswith("array"):
            return "CAST(NULL AS VARCHAR)"
        value = f"coalesce(CAST(\"{name}\" AS VARCHAR), 'NULL')"
        return f"(SELECT string_agg({value}, ' | ') FROM (SELECT * FROM {source} LIMIT {sample}))"

    names = ", ".join(f'"{name}"' for name, _ in columns)
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, count(*) AS row_count,
  {len(columns)} AS column_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source})) AS duplicate_count,
  count(*) - count("{name}") AS null_count, (count(*) - count("{name}")) / count(*) AS null_rate,
  {bounds(name, kind, "min")} AS first_timestamp, {bounds(name, kind, "max")} AS last_timestamp,
  {shown(name, kind)} AS sample_values FROM {source}"""
        for name, kind in columns
    )


def _describe(table: str, listed: str, source: str) -> str:
    rows = ", ".join(f"({i}, '{name}', '{kind}')" for i, (name, kind) in enumerate(_columns(listed), start=1))
    return (
        f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {source}) AS row_count, TRUE AS nullable, v.* "
        f"FROM (VALUES {rows}) v(column_position, column_name, data_type)"
    )


def _counts(sources: dict[tuple[str, str], str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{schema}' AS schema_name, '{table}' AS table_name, count(*) AS row_count FROM {cte}"
        for (schema, table), cte in sources.items()
    )


def _checks() -> str:
    key = "campus_id, meter_id, reading_timestamp"
    wide_key = "campus_id, building_id, meter_id, reading_timestamp"
    specs = (
        ("silver_building_electricity_readings", "building", key, ("consumption", "source_system")),
        ("silver_nmi_electricity_readings", "nmi", key, ("consumption", "demand_kw", "demand_kva", "source_system")),
        (
            "silver_submeter_electricity_readings", "submeter", wide_key,
            ("consumption", '"current"', "voltage", "power", "power_factor", "source_system"),
        ),
    )
    return "\n  UNION ALL".join(
        CHECK.format(
            table=table, cte=cte, keys=keys,
            missing=" OR ".join(f"{name} IS NULL" for name in (*keys.split(", "), *others)),
        )
        for table, cte, keys, others in specs
    )


def build_oracles(campuses: list[int], sources: list[str], event: dict, search: str, targets: list[tuple[float, float]]) -> dict[str, str]:
    """Query name -> SQL text."""
    campus_list = ", ".join(map(str, campuses))
    source_list = ", ".join(f"'{s}'" for s in sources)
    pick = f"campus_id IN ({campus_list}) AND source_system IN ({source_list})"
    pick_campus = f"campus_id IN ({campus_list})"
    shares = [f"(CAST({target} AS DOUBLE), CAST({flexible} AS DOUBLE))" for target, flexible in targets]
    one_target, all_targets = (
        LAYERS.strip().format(checks=_checks(), targets=", ".join(listed), **event) for listed in (shares[:1], shares)
    )

    def over_layers(body: str, doubles: str = "", layers: str = one_target) -> str:
        """A statement over the layer expressions with its double columns at six digits."""
        rounding = ", ".join(f'round("{name}", 6) + 0.0 AS "{name}"' for name in doubles.split())
        chosen = f"* REPLACE ({rounding})" if rounding else "*"
        return f"WITH {layers}\nSELECT {chosen} FROM (\n{body}\n)"

    def plain(body: str, doubles: str) -> str:
        rounding = ", ".join(f'round("{name}", 6) + 0.0 AS "{name}"' for name in doubles.split())
        return f"SELECT * REPLACE ({rounding}) FROM (\n{body}\n)"

    line_chunks = _chunks("chunks", "SELECT doc_id, text FROM documents", "doc_id", r"\n").strip()
    page_chunks = _chunks("chunks", PAGE_TEXT, "page_id", r"\n\s*\n").strip()
    terms = ", ".join(
        f"'{w}'" for w in sorted(set(search.lower().split())) if len(w) > 1 and f"'{w}'" not in STOP.split(", ")
    )
    meter_order = "campus_id, source_system, meter_id, building_id NULLS LAST"
    month_order = "usage_month, campus_id, source_system"
    rates = (
        "count(*) AS baseline_rows, count(*) FILTER (WHERE is_high_usage_candidate) AS high_usage_candidates, "
        "CAST(count(*) FILTER (WHERE is_high_usage_candidate) AS DOUBLE) / count(*) AS high_usage_rate"
    )
    month_of_hour = "CAST(date_trunc('month', usage_hour) AS DATE) AS usage_month"
    trend = (
        f"SELECT {month_of_hour}, campus_id, source_system, sum(actual_consumption) AS actual_consumption, "
        "sum(expected_consumption) AS expected_consumption, sum(residual_consumption) AS residual_consumption "
        f"FROM baseline WHERE {pick} GROUP BY ALL"
    )
    trend_doubles = "actual_consumption expected_consumption residual_consumption"
    heatmap = (
        "SELECT dayname(usage_hour) AS day_of_week, CAST(dayofweek(usage_hour) AS INTEGER) AS day_order, "
        "CAST(hour(usage_hour) AS INTEGER) AS hour_of_day, avg(total_consumption) AS avg_consumption "
        f"FROM hourly WHERE {pick} GROUP BY ALL"
    )
    response_summary = (
        "SELECT event_date, start_hour, end_hour, target_reduction_percent, flexible_load_percent, "
        "rebound_window_hours, count(*) AS simulated_events, "
        "count(*) FILTER (WHERE target_met) AS events_meeting_target, "
        "CAST(count(*) FILTER (WHERE target_met) AS DOUBLE) / count(*) AS target_achievement_rate, "
        "sum(baseline_event_consumption) AS baseline_event_consumption, "
        "sum(simulated_event_consumption) AS simulated_event_consumption, "
        "sum(target_reduction) AS target_reduction, sum(achieved_reduction) AS achieved_reduction, "
        "sum(unmet_reduction) AS unmet_reduction, sum(rebound_load) AS rebound_load, "
        "count(*) FILTER (WHERE NOT total_energy_preserved) AS energy_preservation_failures, "
        "count(*) FILTER (WHERE negative_load_created) AS negative_load_failures "
        f"FROM responses WHERE {pick} GROUP BY ALL"
    )
    profile_doubles = "null_rate"
    summary_subqueries = {
        "total_consumption": f"SELECT coalesce(sum(total_consumption), 0) FROM monthly WHERE {pick}",
        "latest_month_consumption": "SELECT coalesce(max(v) FILTER (WHERE r = 1), 0) FROM months",
        "previous_month_consumption": "SELECT coalesce(max(v) FILTER (WHERE r = 2), 0) FROM months",
        "usage_delta_percent": "SELECT coalesce((max(v) FILTER (WHERE r = 1) - max(v) FILTER (WHERE r = 2)) "
        "/ nullif(max(v) FILTER (WHERE r = 2), 0), 0) FROM months",
        "estimated_emissions_kg_co2e": "SELECT coalesce(sum(estimated_emissions_kg_co2e), 0) "
        f"FROM emissions WHERE {pick}",
        "peak_demand_kw": f"SELECT coalesce(max(peak_demand_kw), 0) FROM peaks WHERE {pick_campus}",
        "high_usage_rate": "SELECT coalesce(CAST(count(*) FILTER (WHERE is_high_usage_candidate) AS DOUBLE) "
        f"/ nullif(count(*), 0), 0) FROM baseline WHERE {pick}",
        "best_peak_reduction": f"SELECT coalesce(max(peak_reduction), 0) FROM shifts WHERE {pick}",
    }
    executive = (
        "WITH months AS (SELECT sum(total_consumption) AS v, row_number() OVER (ORDER BY usage_month DESC) AS r "
        f"FROM monthly WHERE {pick} GROUP BY usage_month) SELECT "
        + ", ".join(f"CAST(({query}) AS DOUBLE) AS {name}" for name, query in summary_subqueries.items())
    )
    hour_cells = ", ".join(
        f'round_even(max(avg_consumption) FILTER (WHERE hour_of_day = {h}), 1) AS "{h}"' for h in range(24)
    )
    emission_doubles = "total_consumption emissions_factor_kg_co2e_per_kwh estimated_emissions_kg_co2e"
    recon_doubles = "nmi_consumption building_consumption consumption_difference difference_ratio_to_nmi"
    peak_doubles = "peak_demand_kw peak_demand_kva"
    shift_doubles = "baseline_peak_consumption simulated_peak_consumption peak_reduction peak_reduction_percent"
    response_doubles = (
        "baseline_event_consumption simulated_event_consumption target_reduction achieved_reduction "
        "unmet_reduction rebound_load"
    )
    top_usage = f"SELECT * FROM monthly ORDER BY total_consumption DESC, {month_order} LIMIT 20"
    top_emissions = (
        "SELECT campus_id, source_system, usage_month, total_consumption, emissions_factor_kg_co2e_per_kwh, "
        "estimated_emissions_kg_co2e FROM emissions "
        f"ORDER BY estimated_emissions_kg_co2e DESC, {month_order} LIMIT 20"
    )
    searched = (
        f"WITH {line_chunks}\nSELECT * FROM (SELECT *, CAST(len(list_intersect("
        f"{_words("heading || ' ' || text")}, [{terms}])) AS INTEGER) AS score FROM chunks) "
        "WHERE score > 0 ORDER BY score DESC, doc_id, section_no, paragraph_no LIMIT "
    )
    stats_of_responses = (
        "SELECT count(*) AS row_count, count(*) FILTER (WHERE target_met) AS events_meeting_target, "
        "count(*) FILTER (WHERE NOT total_energy_preserved) AS energy_preservation_failures, "
        "count(*) FILTER (WHERE negative_load_created) AS negative_load_failures, "
        "coalesce(max(achieved_reduction), 0) AS max_achieved_reduction FROM responses"
    )
    totals_of_responses = (
        "SELECT CAST(coalesce(sum(simulated_events), 0) AS BIGINT) AS simulated_events, "
        "CAST(coalesce(sum(events_meeting_target), 0) AS BIGINT) AS events_meeting_target, "
        "CAST(coalesce(sum(energy_preservation_failures), 0) AS BIGINT) AS energy_preservation_failures, "
        "CAST(coalesce(sum(negative_load_failures), 0) AS BIGINT) AS negative_load_failures, "
        "coalesce(sum(achieved_reduction), 0) AS achieved_reduction, "
        "coalesce(sum(unmet_reduction), 0) AS unmet_reduction, coalesce(sum(rebound_load), 0) AS rebound_load, "
        "coalesce(CAST(sum(events_meeting_target) AS DOUBLE) / nullif(sum(simulated_events), 0), 0) "
        f"AS target_achievement_rate FROM ({response_summary})"
    )
    total_doubles = "achieved_reduction unmet_reduction rebound_load target_achievement_rate"
    largest_gaps = (
        f"SELECT * FROM recon_monthly WHERE {pick_campus} "
        "ORDER BY abs(consumption_difference) DESC NULLS LAST, usage_month, campus_id LIMIT "
    )
    hours_with_temperature = (
        "SELECT campus_id, source_system, usage_hour, air_temperature, actual_consumption FROM baseline "
        f"WHERE {pick} ORDER BY usage_hour, {meter_order} LIMIT "
    )
    best_responses = (
        "SELECT campus_id, source_system, meter_id, building_id, event_date, start_hour, end_hour, "
        "target_reduction_percent, flexible_load_percent, baseline_event_consumption, "
        "simulated_event_consumption, target_reduction, achieved_reduction, unmet_reduction, target_met, "
        "rebound_load, total_energy_preserved, negative_load_created, notes FROM responses "
        f"WHERE {pick} ORDER BY achieved_reduction DESC, {meter_order} LIMIT "
    )
    return {
        "discover_sources": " UNION ALL ".join(
            f"SELECT '{table}.parquet' AS file_name, 'parquet' AS format" for table in TABLE_SCHEMAS
        ),
        "read_raw": plain("SELECT * FROM events", "value"),
        "ingest_bronze": over_layers(
            "SELECT 'bronze.bronze_building_consumption' AS table_name, count(*) AS row_count, 4 AS column_count, "
            "count(*) FILTER (WHERE meter_id = 7) AS bad_record_count FROM bronze_building UNION ALL "
            "SELECT 'bronze.bronze_nmi_consumption', count(*), 6, count(*) FILTER (WHERE meter_id = 7) FROM bronze_nmi"
        ),
        "ingest_bronze_bad_records": over_layers(
            " UNION ALL ".join(
                f"SELECT 'bronze_{name}' AS table_name, '{name}.csv' AS source, {campus} AS campus, '7?' AS meter, "
                "strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.000') AS moment, "
                f"{n} AS n_fields FROM {cte} WHERE meter_id = 7"
                for name, campus, n, cte in (
                    ("building_consumption", "CAST(campus_id AS VARCHAR)", 4, "bronze_building"),
                    ("nmi_consumption", "campus_id", 6, "bronze_nmi"),
                )
            )
        ),
        "write_layer_refused": over_layers(
            "SELECT *, count(*) OVER () AS recorded_rows FROM daily WHERE usage_date >= DATE '2024-01-01'",
            "total_consumption",
        ),
        "load_emissions_factors": over_layers("SELECT * FROM factors", "emissions_factor_kg_co2e_per_kwh"),
        "load_grid_intensity": over_layers("SELECT * FROM intensity", "emissions_intensity_kg_co2e_per_kwh"),
        "validate_grid_intensity": over_layers(
            "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS null_interval_start, "
            "CAST(0 AS BIGINT) AS null_interval_end, count(*) FILTER (WHERE k % 7 = 0) AS null_intensity, "
            "count(*) FILTER (WHERE k % 7 <> 0 AND k % 11 = 0) AS negative_intensity, "
            "(SELECT count(*) FROM (SELECT 1 FROM station_hours GROUP BY region_code, \"hour\" "
            "HAVING count(*) > 1)) AS duplicate_region_hours FROM station_hours"
        ),
        "register_reference": over_layers(
            "SELECT region_code, interval_start_hour, TRUE AS has_load_time FROM intensity"
        ),
        "write_layer": over_layers("SELECT * FROM hourly", "total_consumption"),
        "table_inventory": over_layers(_counts(LAYER_SOURCES)),
        "layer_row_funnel": over_layers(
            "SELECT schema_name, CAST(sum(row_count) AS BIGINT) AS row_count "
            f"FROM ({_counts(LAYER_SOURCES)}) GROUP BY schema_name"
        ),
        "describe_table": over_layers(_describe("gold.gold_hourly_electricity_usage", HOURLY_COLUMNS, "hourly")),
        "clean_building_readings": over_layers("SELECT * FROM building", "consumption"),
        "clean_nmi_readings": over_layers("SELECT * FROM nmi", "consumption demand_kw demand_kva"),
        "clean_submeter_readings": over_layers(
            "SELECT * FROM submeter", "consumption current voltage power power_factor"
        ),
        "clean_readings": over_layers(
            "SELECT campus_id, date_trunc('hour', ts) AS \"hour\", CAST(k AS DOUBLE) AS consumption, "
            "CAST(15 + k % 10 AS DOUBLE) AS air_temperature, 'weather_data' AS source_system FROM bronze_weather "
            "WHERE k >= 0 AND k % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY campus_id, \"hour\" ORDER BY k) = 1",
            "consumption air_temperature",
        ),
        "hourly_usage": over_layers("SELECT * FROM hourly", "total_consumption"),
        "daily_usage": over_layers("SELECT * FROM daily", "total_consumption"),
        "monthly_usage": over_layers("SELECT * FROM monthly", "total_consumption"),
        "peak_demand": over_layers("SELECT * FROM peaks", f"{peak_doubles} consumption_at_peak"),
        "emissions_monthly": over_layers("SELECT * FROM emissions", emission_doubles),
        "emissions_monthly_stats": over_layers(
            "SELECT count(*) AS row_count, (SELECT count(*) FROM factors) AS factor_count, "
            "count(*) FILTER (WHERE used_default_factor) AS default_factor_count FROM emissions"
        ),
        "emissions_time_varying": over_layers(
            "SELECT * FROM time_varying",
            "total_consumption static_emissions_factor_kg_co2e_per_kwh static_estimated_emissions_kg_co2e "
            "time_varying_emissions_factor_kg_co2e_per_kwh time_varying_estimated_emissions_kg_co2e",
        ),
        "emissions_match_stats": over_layers(
            "SELECT (SELECT count(*) FROM intensity) AS reference_row_count, count(*) AS gold_row_count, "
            + ", ".join(
                f"count(*) FILTER (WHERE factor_match_status = '{s}') AS {s}_count"
                for s in ("matched_hourly_factor", "fallback_static_factor", "missing_hourly_factor")
            )
            + " FROM time_varying"
        ),
        "reconcile_daily": over_layers("SELECT * FROM recon_daily", recon_doubles),
        "reconcile_monthly": over_layers("SELECT * FROM recon_monthly", recon_doubles),
        "hourly_weather": over_layers(
            "SELECT * FROM weather", "air_temperature apparent_temperature relative_humidity"
        ),
        "weather_baseline": over_layers(
            "SELECT * FROM baseline",
            f"{trend_doubles} residual_percent air_temperature apparent_temperature relative_humidity "
            "temperature_band_c efficiency_opportunity_score",
        ),
        "weather_baseline_stats": over_layers(
            "SELECT count(*) AS row_count, "
            "count(*) FILTER (WHERE is_high_usage_candidate) AS high_usage_candidate_count FROM baseline"
        ),
        "shift_scenarios": over_layers(
            "SELECT * FROM shifts",
            f"flexible_load_percent baseline_daily_consumption baseline_target_consumption shifted_consumption "
            f"simulated_daily_consumption {shift_doubles}",
        ),
        "shift_scenario_stats": over_layers(
            "SELECT count(*) AS row_count, coalesce(max(peak_reduction), 0) AS max_peak_reduction, "
            "count(*) FILTER (WHERE NOT total_energy_preserved OR negative_usage_created) "
            "AS energy_preserved_failures FROM shifts",
            "max_peak_reduction",
        ),
        "event_response_scenarios": over_layers(
            "SELECT * FROM responses",
            f"target_reduction_percent flexible_load_percent {response_doubles} baseline_rebound_consumption "
            "simulated_rebound_consumption target_achievement_ratio estimated_emissions_impact_kg_co2e",
        ),
        "event_response_stats": over_layers(stats_of_responses, "max_achieved_reduction"),
        "event_response_stats_unmet": over_layers(stats_of_responses, "max_achieved_reduction", all_targets),
        "top_monthly_usage": over_layers(top_usage, "total_consumption"),
        "peak_demand_by_meter": over_layers(
            "SELECT * FROM peaks ORDER BY peak_demand_kw DESC, campus_id, meter_id LIMIT 20",
            f"{peak_doubles} consumption_at_peak",
        ),
        "monthly_emissions_summary": over_layers(top_emissions, emission_doubles),
        "source_usage_summary": over_layers(
            "SELECT source_system, count(*) AS monthly_rows, sum(total_consumption) AS total_consumption, "
            "CAST(sum(reading_count) AS BIGINT) AS total_readings FROM monthly GROUP BY source_system",
            "total_consumption",
        ),
        "run_sql_reports": over_layers(
            "SELECT 'monthly_emissions_summary' AS query_name, least(count(*), 20) AS row_count FROM emissions "
            "UNION ALL SELECT 'peak_demand_by_meter', least(count(*), 20) FROM peaks "
            "UNION ALL SELECT 'source_usage_summary', count(DISTINCT source_system) FROM monthly "
            "UNION ALL SELECT 'top_monthly_usage', least(count(*), 20) FROM monthly"
        ),
        "run_sql_report_result": over_layers(top_emissions, emission_doubles),
        "question_table_row_count": over_layers("SELECT count(*) AS row_count FROM hourly"),
        "question_top_peak_demand": over_layers(
            "SELECT * EXCLUDE (consumption_at_peak) FROM peaks "
            "ORDER BY peak_demand_kw DESC, campus_id, meter_id LIMIT 10",
            peak_doubles,
        ),
        "question_top_monthly_usage": over_layers(
            "SELECT campus_id, source_system, usage_month, total_consumption FROM monthly "
            f"ORDER BY total_consumption DESC, {month_order} LIMIT 10",
            "total_consumption",
        ),
        "question_top_high_usage": over_layers(
            "SELECT campus_id, source_system, meter_id, building_id, usage_hour, actual_consumption, "
            "expected_consumption, residual_consumption, efficiency_opportunity_score FROM baseline "
            "WHERE is_high_usage_candidate ORDER BY efficiency_opportunity_score DESC, "
            f"residual_consumption DESC, {meter_order}, usage_hour LIMIT 10",
            f"{trend_doubles} efficiency_opportunity_score",
        ),
        "question_events_meeting_target": over_layers(
            "SELECT count(*) AS simulated_events, count(*) FILTER (WHERE target_met) AS events_meeting_target "
            "FROM responses"
        ),
        "question_rows_per_match_status": over_layers(
            "SELECT factor_match_status, count(*) AS row_count FROM time_varying GROUP BY ALL"
        ),
        "filter_options": over_layers(
            "SELECT DISTINCT 'campus_id' AS option, CAST(campus_id AS VARCHAR) AS value FROM monthly "
            "UNION ALL SELECT DISTINCT 'source_system', source_system FROM monthly"
        ),
        "report_monthly_usage": over_layers(
            f"SELECT usage_month, campus_id, source_system, total_consumption FROM monthly WHERE {pick}",
            "total_consumption",
        ),
        "report_executive_summary": over_layers(executive, " ".join(summary_subqueries)),
        "report_monthly_by_campus": over_layers(
            f"SELECT usage_month, campus_id, sum(total_consumption) AS total_consumption FROM monthly "
            f"WHERE {pick} GROUP BY ALL",
            "total_consumption",
        ),
        "report_hourly_heatmap": over_layers(heatmap, "avg_consumption"),
        "report_heatmap_pivot": over_layers(
            f"SELECT day_of_week, {hour_cells} FROM ({heatmap}) GROUP BY day_of_week",
            " ".join(map(str, range(24))),
        ),
        "report_top_usage_entities": over_layers(
            "SELECT campus_id, source_system, meter_id, building_id, sum(total_consumption) AS total_consumption "
            f"FROM hourly WHERE {pick} GROUP BY ALL ORDER BY sum(total_consumption) DESC, {meter_order} LIMIT 20",
            "total_consumption",
        ),
        "report_peak_demand": over_layers(
            f"SELECT * EXCLUDE (consumption_at_peak) FROM peaks WHERE {pick_campus} "
            "ORDER BY peak_demand_kw DESC, campus_id, meter_id LIMIT 20",
            peak_doubles,
        ),
        "report_emissions": over_layers(
            "SELECT usage_month, campus_id, source_system, total_consumption, factor_id, factor_region, factor_year, "
            "emissions_factor_kg_co2e_per_kwh, factor_source_name, used_default_factor, estimated_emissions_kg_co2e "
            f"FROM emissions WHERE {pick}",
            emission_doubles,
        ),
        "report_emissions_assumptions": over_layers(
            "SELECT DISTINCT factor_id, factor_region, factor_year, emissions_factor_kg_co2e_per_kwh, "
            "factor_source_name, factor_source_url, used_default_factor, factor_notes FROM emissions",
            "emissions_factor_kg_co2e_per_kwh",
        ),
        "report_reconciliation": over_layers(f"{largest_gaps}30", recon_doubles),
        "report_reconciliation_limited": over_layers(f"{largest_gaps}5", recon_doubles),
        "report_baseline_summary": over_layers(
            f"SELECT campus_id, source_system, {rates}, avg(residual_percent) AS avg_residual_percent, "
            "max(efficiency_opportunity_score) AS max_efficiency_opportunity_score "
            f"FROM baseline WHERE {pick_campus} GROUP BY ALL",
            "high_usage_rate avg_residual_percent max_efficiency_opportunity_score",
        ),
        "report_actual_expected_trend": over_layers(trend, trend_doubles),
        "report_trend_all_sources": over_layers(
            "SELECT usage_month, sum(actual_consumption) AS actual_consumption, "
            "sum(expected_consumption) AS expected_consumption, sum(residual_consumption) AS residual_consumption "
            f"FROM ({trend}) GROUP BY usage_month",
            trend_doubles,
        ),
        "report_candidate_rate_trend": over_layers(
            f"SELECT {month_of_hour}, campus_id, source_system, {rates} FROM baseline WHERE {pick} GROUP BY ALL",
            "high_usage_rate",
        ),
        "report_temperature_sample": over_layers(f"{hours_with_temperature}5000", "air_temperature actual_consumption"),
        "report_temperature_sample_limited": over_layers(f"{hours_with_temperature}700", "air_temperature actual_consumption"),
        "report_top_candidates": over_layers(
            "SELECT campus_id, source_system, meter_id, building_id, usage_hour, actual_consumption, "
            "expected_consumption, residual_consumption, residual_percent, efficiency_opportunity_score "
            f"FROM baseline WHERE {pick_campus} AND is_high_usage_candidate "
            "ORDER BY efficiency_opportunity_score DESC, residual_consumption DESC, "
            f"{meter_order}, usage_hour LIMIT 50",
            f"{trend_doubles} residual_percent efficiency_opportunity_score",
        ),
        "report_shift_summary": over_layers(
            "SELECT campus_id, source_system, count(*) AS simulation_rows, "
            + ", ".join(f"avg({name}) AS avg_{name}" for name in shift_doubles.split())
            + ", count(*) FILTER (WHERE total_energy_preserved) AS energy_preserved_rows FROM shifts "
            f"WHERE {pick_campus} AND flexible_load_percent = 0.10 GROUP BY ALL",
            " ".join(f"avg_{name}" for name in shift_doubles.split()),
        ),
        "report_shift_comparison": over_layers(
            "SELECT flexible_load_percent, count(*) AS valid_scenarios, avg(peak_reduction) AS avg_peak_reduction, "
            "avg(peak_reduction_percent) AS avg_peak_reduction_percent, max(peak_reduction) AS best_peak_reduction, "
            "count(*) FILTER (WHERE NOT total_energy_preserved) AS energy_preservation_failures, "
            "count(*) FILTER (WHERE negative_usage_created) AS negative_usage_rows, "
            f"count(*) FILTER (WHERE peak_reduction < 0) AS worse_peak_rows FROM shifts WHERE {pick} GROUP BY ALL",
            "flexible_load_percent avg_peak_reduction avg_peak_reduction_percent best_peak_reduction",
        ),
        "report_shift_top": over_layers(
            "SELECT campus_id, source_system, meter_id, building_id, simulation_date, flexible_load_percent, "
            "baseline_peak_consumption, simulated_peak_consumption, peak_reduction, peak_reduction_percent, "
            f"total_energy_preserved, notes FROM shifts WHERE {pick_campus} AND flexible_load_percent = 0.10 "
            f"ORDER BY peak_reduction DESC, {meter_order}, simulation_date LIMIT 50",
            f"flexible_load_percent {shift_doubles}",
        ),
        "report_response_summary": over_layers(
            response_summary,
            f"target_reduction_percent flexible_load_percent target_achievement_rate {response_doubles}",
        ),
        "report_response_summary_unmet": over_layers(
            response_summary,
            f"target_reduction_percent flexible_load_percent target_achievement_rate {response_doubles}",
            all_targets,
        ),
        "report_response_totals": over_layers(totals_of_responses, total_doubles),
        "report_response_totals_unmet": over_layers(totals_of_responses, total_doubles, all_targets),
        "report_response_components": over_layers(
            " UNION ALL ".join(
                f"SELECT '{label}' AS load_component, sum({name}) AS total_consumption FROM responses WHERE {pick}"
                for label, name in (
                    ("Baseline event load", "baseline_event_consumption"),
                    ("Simulated event load", "simulated_event_consumption"),
                    ("Rebound load", "rebound_load"),
                )
            ),
            "total_consumption",
        ),
        "report_response_top": over_layers(
            f"{best_responses}50", f"target_reduction_percent flexible_load_percent {response_doubles}"
        ),
        "report_response_top_limited": over_layers(
            f"{best_responses}4", f"target_reduction_percent flexible_load_percent {response_doubles}"
        ),
        "failed_checks": over_layers("SELECT name, table_name, observed_value, expected FROM checks WHERE status = 'FAIL'"),
        "event_setting_problems": plain(
            "SELECT *, concat_ws('; ', CASE WHEN end_hour <= start_hour THEN 'end_hour' END, "
            "CASE WHEN target_percent NOT BETWEEN 0 AND 1 THEN 'target_percent' END, "
            "CASE WHEN flexible_percent NOT BETWEEN 0 AND 1 THEN 'flexible_percent' END, "
            "CASE WHEN rebound_hours < 1 THEN 'rebound_hours' END) AS problems FROM ("
            "SELECT l_orderkey, l_linenumber, CAST(dayofyear(l_shipdate) % 20 AS INTEGER) AS start_hour, "
            "CAST(dayofyear(l_shipdate) % 20 + l_linenumber - 2 AS INTEGER) AS end_hour, "
            "CASE WHEN l_quantity > 3 THEN l_discount ELSE l_quantity END AS target_percent, "
            "CASE WHEN l_returnflag = 'R' THEN -l_tax ELSE l_tax END AS flexible_percent, "
            "l_partkey % 5 AS rebound_hours FROM lineitem)",
            "target_percent flexible_percent",
        ),
        "report_quality_summary": over_layers("SELECT status, count(*) AS check_count FROM checks GROUP BY status"),
        "quality_checks": over_layers("SELECT * FROM checks"),
        "profile_table": over_layers(
            _profile("bronze_building_consumption", BUILDING_FEED_COLUMNS, "bronze_building"), profile_doubles
        ),
        "profile_documents": plain(
            _profile("documents", TABLE_SCHEMAS["documents"], "documents", 3), profile_doubles
        ),
        "timestamp_coverage": over_layers(
            "SELECT 'bronze_building_consumption' AS table_name, 'timestamp' AS column_name, "
            'min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM bronze_building'
        ),
        "profile_all": plain(
            " UNION ALL ".join(
                _profile(f"bronze_{table}", listed, table) for table, listed in TABLE_SCHEMAS.items()
            ),
            profile_doubles,
        ),
        "chunk_documents": f"WITH {line_chunks}\nSELECT * FROM chunks",
        "chunk_pages": f"WITH {page_chunks}\nSELECT * FROM chunks",
        "tokenize": "SELECT doc_id, CAST(len(terms) AS INTEGER) AS term_count, "
        f"array_to_string(terms, ' ') AS terms FROM (SELECT doc_id, {_words('text')} AS terms FROM documents)",
        "keyword_search_index": f"{searched}40",
        "keyword_search_batch": f"WITH {line_chunks}, hits AS (SELECT item_id AS query_id, doc_id, section_no, "
        "paragraph_no, heading, count(*) AS score "
        f"FROM (SELECT *, unnest({_words("heading || ' ' || text")}) AS term FROM chunks) c "
        f"JOIN (SELECT item_id, unnest({_words('text')}) AS term FROM benchmark) q USING (term) GROUP BY ALL) "
        "SELECT * REPLACE (CAST(score AS INTEGER) AS score), CAST(row_number() OVER (PARTITION BY query_id "
        "ORDER BY score DESC, doc_id, section_no, paragraph_no) AS INTEGER) AS rank FROM hits QUALIFY rank <= 3",
        "keyword_search": f"{searched}5",
    }
