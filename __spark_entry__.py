"""Registered queries and their SQL counterparts over the test tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from contextlib import contextmanager
from functools import cached_property, reduce
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridmill.functions import floor_to_hour, month_start  # noqa: E402
from gridmill.names import LAYERS, SOURCE_SYSTEMS  # noqa: E402
from gridmill.operators import baseline, emissions, profile, quality, reconcile, retrieval  # noqa: E402
from gridmill.operators import scenarios, silver, usage  # noqa: E402
from gridmill.plans import marts, questions, reports  # noqa: E402
from gridmill.sources import layers, raw, reference  # noqa: E402
from gridmill.session import run_folder  # noqa: E402
import event_feed as feed  # noqa: E402
from oracle_queries import build_oracles  # noqa: E402

try:
    import corpus_pipeline
    from gridmill.llm import queries as llm_queries
except ImportError:  # the training-data operators are an optional part
    llm_queries = corpus_pipeline = None

# Some of the five campuses and two of the three sources, so that a report that ignored its selection would show.
CAMPUSES = [2, 5]
SOURCES = [SOURCE_SYSTEMS[0], SOURCE_SYSTEMS[2]]
EVENT = {"event_date": "2024-01-15", "start_hour": 15, "end_hour": 18}
#: Target and flexible share of that event: one target that can be reached, and one that can't.
TARGETS = [(0.10, 0.15), (0.30, 0.15)]
SEARCH = "the energy and ment of eaux thering la"
SQL_REPORTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "gridmill", "plans", "sql")


class Tables:
    """Lazy frames of every layer over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, feeds: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # Feeds that are stored already stand in for those projected from the events.
        self.__dict__.update(feeds or {})

    def table(self, name: str) -> DataFrame:
        return raw.read_raw(self.spark, f"{self.sf_dir}/{name}.parquet", feed.TABLE_SCHEMAS[name])

    @cached_property
    def all_tables(self) -> dict[str, tuple[str, DataFrame]]:
        schemas = {f"bronze_{name}": schema for name, schema in feed.TABLE_SCHEMAS.items()}
        return raw.bronze_frames(self.spark, self.sf_dir, schemas)

    @cached_property
    def events(self) -> DataFrame:
        return feed.spread_months(self.table("events"))

    @cached_property
    def bronze_building(self) -> DataFrame:
        return feed.building_feed(self.events)

    @cached_property
    def bronze_nmi(self) -> DataFrame:
        return feed.nmi_feed(self.events)

    @cached_property
    def bronze_submeter(self) -> DataFrame:
        return feed.submeter_feed(self.events)

    @cached_property
    def bronze_weather(self) -> DataFrame:
        return feed.weather_feed(self.events)

    @cached_property
    def campus_meta(self) -> DataFrame:
        return feed.campus_meta_feed(self.table("region"))

    @cached_property
    def building(self) -> DataFrame:
        return silver.clean_building_readings(self.bronze_building)

    @cached_property
    def nmi(self) -> DataFrame:
        return silver.clean_nmi_readings(self.bronze_nmi)

    @cached_property
    def submeter(self) -> DataFrame:
        return silver.clean_submeter_readings(self.bronze_submeter)

    @cached_property
    def hourly(self) -> DataFrame:
        return usage.hourly_usage(self.building, self.nmi, self.submeter)

    @cached_property
    def daily(self) -> DataFrame:
        return usage.daily_usage(self.hourly)

    @cached_property
    def monthly(self) -> DataFrame:
        return usage.monthly_usage(self.daily)

    @cached_property
    def peaks(self) -> DataFrame:
        return usage.peak_demand(self.nmi)

    @cached_property
    def factors(self) -> DataFrame:
        return reference.parse_emissions_factors(feed.factor_text_feed(self.table("supplier")))

    @cached_property
    def intensity(self) -> DataFrame:
        return reference.parse_grid_intensity(feed.intensity_text_feed(self.events))

    @cached_property
    def dirty_intensity(self) -> DataFrame:
        return reference.parse_grid_intensity(feed.dirty_intensity_text_feed(self.events))

    @cached_property
    def run_folder(self) -> str:
        """A folder of this run's own in the shared storage of the cluster."""
        return run_folder(self.spark, "queries")

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return layers.store(df, f"{self.run_folder}/{name}")

    @cached_property
    def stored_hourly(self) -> DataFrame:
        """Hourly usage, written once for queries that read it several times."""
        return self.store(self.hourly, "hourly_usage")

    def layer_table(self) -> DataFrame:
        """Hourly usage as a partitioned layer table, read back; its database is this run's own and is dropped."""
        hourly = self.hourly.withColumn("usage_month", month_start("usage_hour"))
        with self.own_databases("run") as (layer,):
            layers.write_layer(hourly, f"{layer}.hourly", ["usage_month"], ["usage_hour"], root=self.run_folder)
        return self.spark.read.parquet(f"{self.run_folder}/{layer}/hourly").select(*self.hourly.columns)

    @cached_property
    def emissions(self) -> DataFrame:
        return emissions.emissions_monthly(self.monthly, self.factors)

    @cached_property
    def time_varying(self) -> DataFrame:
        # As in the full build, the small sides are stored first, so that the planner knows their size.
        hourly = self.stored_hourly
        monthly = usage.monthly_usage(usage.daily_usage(hourly))
        static = self.store(emissions.emissions_monthly(monthly, self.factors), "static")
        return emissions.emissions_time_varying(hourly, static, self.stored_intensity)

    @cached_property
    def stored_intensity(self) -> DataFrame:
        return self.store(self.intensity, "intensity")

    def executive_summary(self, **selection) -> DataFrame:
        hourly = self.stored_hourly
        monthly = usage.monthly_usage(usage.daily_usage(hourly))
        return reports.report_executive_summary(
            monthly,
            emissions.emissions_monthly(monthly, self.factors),
            self.peaks,
            baseline.weather_baseline(hourly, self.stored_weather),
            scenarios.shift_scenarios(hourly),
            **selection,
        )

    @cached_property
    def recon_daily(self) -> DataFrame:
        return reconcile.reconcile_daily(self.daily)

    @cached_property
    def recon_monthly(self) -> DataFrame:
        return reconcile.reconcile_monthly(self.recon_daily)

    @cached_property
    def weather(self) -> DataFrame:
        return baseline.hourly_weather(self.bronze_weather)

    @cached_property
    def stored_weather(self) -> DataFrame:
        return self.store(self.weather, "weather")

    @cached_property
    def baseline(self) -> DataFrame:
        return baseline.weather_baseline(self.hourly, self.stored_weather)

    @cached_property
    def shifts(self) -> DataFrame:
        return scenarios.shift_scenarios(self.hourly)

    @cached_property
    def responses(self) -> DataFrame:
        return scenarios.event_response_scenarios(self.hourly, **EVENT)

    @cached_property
    def hard_responses(self) -> DataFrame:
        parts = [
            scenarios.event_response_scenarios(self.hourly, **EVENT, target_percent=target, flexible_percent=flexible)
            for target, flexible in TARGETS
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def checks(self) -> DataFrame:
        return quality.quality_checks(self.building, self.nmi, self.submeter, self.campus_meta)

    @cached_property
    def line_chunks(self) -> DataFrame:
        return retrieval.chunk_documents(self.table("documents"), "doc_id", separator="\n")

    @cached_property
    def page_chunks(self) -> DataFrame:
        return retrieval.chunk_documents(feed.page_markdown(self.table("pages")), "page_id")

    def searched(self, search: Callable[[retrieval.DocumentIndex], DataFrame]) -> DataFrame:
        """The result of a search in an index of the documents' lines, stored in this run's folder."""
        with self.own_databases("documents") as (own,):
            retrieval.build_document_index(self.line_chunks, own, "doc_id", root=self.run_folder)
            return self.store(search(retrieval.open_document_index(self.spark, own)), "hits")

    @contextmanager
    def own_databases(self, *names: str):
        """Databases of this run's own, one for each name, that are gone at the end; their files stay for the run."""
        run = uuid4().hex
        own = [f"{name}_{run}" for name in names]
        try:
            yield own
        finally:
            for name in own:
                for database in (name, raw.QUARANTINE.format(name)):
                    self.spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")

    def refused_refresh(self) -> DataFrame:
        """Daily usage of 2024 after two refreshes that failed: one in its job, one in its check."""
        with self.own_databases("run") as (layer,):
            save = lambda df, **options: layers.write_layer(df, f"{layer}.daily", root=self.run_folder, **options)
            save(self.daily.where("usage_date >= '2024-01-01'"))

            def refuse(stored: DataFrame) -> None:
                raise ValueError(f"{stored.count()} rows refused")

            broken = F.when(F.col("meter_count") > 1, F.raise_error("broken feed").cast("long")).otherwise(F.col("meter_count"))
            for attempt in (
                lambda: save(self.daily.withColumn("meter_count", broken)), lambda: save(self.daily, check=refuse)
            ):
                try:
                    attempt()
                except Exception as error:  # noqa: BLE001 - both have to fail, by what they were given
                    if "broken feed" not in str(error) and "rows refused" not in str(error):
                        raise
                else:
                    raise AssertionError("a refresh that fails was stored")
            kept = self.store(self.spark.table(f"{layer}.daily"), "kept_daily")
            return kept.withColumn("recorded_rows", F.lit(layers.stored_rows(self.spark, f"{layer}.daily")).cast("long"))

    def layer_inventory(self) -> DataFrame:
        """The catalog's row counts after every layer was written to this run's databases, each from the one before."""
        with self.own_databases(*LAYERS) as own:
            place = dict(zip(LAYERS, own))
            save = lambda layer, name, df: layers.write_layer(df, f"{place[layer]}.{name}", root=self.run_folder)
            building = save("bronze", "bronze_building_consumption", self.bronze_building)
            nmi = save("bronze", "bronze_nmi_consumption", self.bronze_nmi)
            submeter = save("bronze", "bronze_building_submeter_consumption", self.bronze_submeter)
            save("bronze", "bronze_weather_data", self.bronze_weather)
            silver_tables = [
                save("silver", "silver_building_electricity_readings", silver.clean_building_readings(building)),
                save("silver", "silver_nmi_electricity_readings", silver.clean_nmi_readings(nmi)),
                save("silver", "silver_submeter_electricity_readings", silver.clean_submeter_readings(submeter)),
            ]
            hourly = save("gold", "gold_hourly_electricity_usage", usage.hourly_usage(*silver_tables))
            save("gold", "gold_daily_electricity_usage", usage.daily_usage(hourly))
            save("gold", "gold_peak_demand", usage.peak_demand(silver_tables[1]))
            save("reference", "reference_emissions_factors", self.factors)
            save("reference", "reference_grid_carbon_intensity_hourly", self.intensity)
            counted = layers.table_inventory(self.spark, own)
            layer = F.split("schema_name", "_")[0].alias("schema_name")
            return self.store(counted.select(layer, "table_name", "row_count"), "inventory")

    def described(self) -> DataFrame:
        with self.own_databases("gold") as own:
            table = f"{own[0]}.gold_hourly_electricity_usage"
            layers.write_layer(self.hourly, table, root=self.run_folder)
            found = layers.describe_table(self.spark, table, own)
            name = F.concat(F.lit("gold."), F.element_at(F.split("table_name", "[.]"), 2))
            return found.withColumn("table_name", name)

    def registered(self) -> DataFrame:
        with self.own_databases("reference") as own:
            table = "reference_grid_carbon_intensity_hourly"
            checked = reference.validate_grid_intensity(self.stored_intensity)
            stored = reference.register_reference(checked, table, stamp=True, root=self.run_folder, layer=own[0])
            return stored.select(
                "region_code", "interval_start_hour", F.col("ingested_at").isNotNull().alias("has_load_time")
            )

    def ingested(self) -> tuple[DataFrame, DataFrame]:
        """Load summary and quarantine of the feeds, written as CSV files and loaded; some records are spoilt on the way."""
        feeds = {"building_consumption": self.bronze_building, "nmi_consumption": self.bronze_nmi}
        spoilt = F.when(F.col("meter_id") == 7, "7?").otherwise(F.col("meter_id").cast("string"))
        for name, frame in feeds.items():
            frame.withColumn("meter_id", spoilt).write.csv(f"{self.run_folder}/raw/{name}.csv", header=True)
        with self.own_databases("bronze") as own:
            summary = raw.ingest_bronze(
                self.spark, f"{self.run_folder}/raw", raw.FEED_SCHEMAS, root=self.run_folder,
                max_bad_records=2**40, layer=own[0],
            )
            table = F.concat(F.lit("bronze."), F.element_at(F.split("table_name", "[.]"), 2)).alias("table_name")
            summary = summary.select(table, "row_count", "column_count", "bad_record_count")
            return summary, self.store(raw.bad_records(self.spark, own[0]), "quarantine")

    def quarantined(self) -> DataFrame:
        """The texts of the spoilt records: their first three fields and the data set of their file."""
        field = F.split("record", ",")
        return self.ingested()[1].select(
            "table_name", F.regexp_extract("source_file", "/raw/([^/]+)/", 1).alias("source"), field[0].alias("campus"),
            field[1].alias("meter"), field[2].alias("moment"), F.size(field).alias("n_fields"),
        )

    def csv_file(self, df: DataFrame, name: str) -> str:
        path = f"{self.run_folder}/{name}.csv"
        df.write.csv(path, header=True, quoteAll=True)
        return path

    @cached_property
    def gold(self) -> dict[str, DataFrame]:
        """The tables that the SQL files name, over one stored copy of the monthly usage."""
        monthly = self.store(self.monthly, "monthly_usage")
        return {
            "gold_monthly_electricity_usage": monthly,
            "gold_electricity_emissions": emissions.emissions_monthly(monthly, self.factors),
            "gold_peak_demand": self.peaks,
        }

    def sql_report_rows(self) -> DataFrame:
        """Row count of every SQL file report, run over the gold frames."""
        results = marts.run_sql_reports(self.spark, SQL_REPORTS, self.gold)
        counts = layers.row_counts({("report", name): result for name, result in results.items()})
        return counts.select(F.col("table_name").alias("query_name"), "row_count")

    def sql_report(self, name: str) -> DataFrame:
        return marts.run_sql_report(self.spark, Path(SQL_REPORTS, f"{name}.sql"), self.gold)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, so that the order of a sum does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), 6) + 0.0).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def readable(profiles: DataFrame) -> DataFrame:
    """A profile with its sample values in one text."""
    return profiles.withColumn("sample_values", F.array_join("sample_values", " | ", "NULL"))


def entry(spark: SparkSession) -> DataFrame:
    """Readings to usage per source: clean, de-duplicate, roll up three times, rank."""
    return rounded(marts.source_usage_summary(Tables(spark, "/root/testdata/sf0.001").monthly))


#: The feeds that the meter operators start from.
FEEDS = ("bronze_building", "bronze_nmi", "bronze_submeter", "bronze_weather")


def stored_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The feeds as files, so that an operator can be timed without the projection of its input."""
    tables = Tables(spark, sf_dir)
    return {name: tables.store(getattr(tables, name), name) for name in FEEDS}


def operators() -> dict[str, Callable[[Tables], DataFrame]]:
    """Query name -> function of the tables."""
    pick = {"campuses": CAMPUSES, "sources": SOURCES}
    campuses = {"campuses": CAMPUSES}
    return {
        # sources and sinks
        "discover_sources": lambda t: raw.discover_sources(t.spark, t.sf_dir).select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"), "format"
        ),
        "read_raw": lambda t: t.table("events"),
        "ingest_bronze": lambda t: t.ingested()[0],
        "ingest_bronze_bad_records": lambda t: t.quarantined(),
        "write_layer_refused": lambda t: t.refused_refresh(),
        "load_emissions_factors": lambda t: reference.load_emissions_factors(
            t.spark, t.csv_file(feed.factor_text_feed(t.table("supplier")), "factors")
        ),
        "load_grid_intensity": lambda t: reference.load_grid_intensity(
            t.spark, t.csv_file(feed.intensity_text_feed(t.events), "intensity_feed")
        ),
        "validate_grid_intensity": lambda t: reference.grid_intensity_problems(t.dirty_intensity),
        "register_reference": lambda t: t.registered(),
        "write_layer": lambda t: t.layer_table(),
        "table_inventory": lambda t: t.layer_inventory(),
        "layer_row_funnel": lambda t: layers.layer_row_funnel(t.layer_inventory()),
        "describe_table": lambda t: t.described(),
        # silver
        "clean_building_readings": lambda t: t.building,
        "clean_nmi_readings": lambda t: t.nmi,
        "clean_submeter_readings": lambda t: t.submeter,
        "clean_readings": lambda t: silver.clean_readings(
            t.bronze_weather,
            {
                "campus_id": F.col("campus_id"), "hour": floor_to_hour("timestamp"),
                "consumption": F.col("relative_humidity"), "air_temperature": F.col("air_temperature"),
            },
            ["campus_id", "hour"], ["consumption", "air_temperature"], "weather_data",
        ),
        # gold
        "hourly_usage": lambda t: t.hourly,
        "daily_usage": lambda t: t.daily,
        "monthly_usage": lambda t: t.monthly,
        "peak_demand": lambda t: t.peaks,
        "emissions_monthly": lambda t: t.emissions,
        "emissions_monthly_stats": lambda t: emissions.emissions_monthly_stats(t.emissions, t.factors),
        "emissions_time_varying": lambda t: t.time_varying,
        "emissions_match_stats": lambda t: emissions.emissions_match_stats(t.time_varying, t.stored_intensity),
        "reconcile_daily": lambda t: t.recon_daily,
        "reconcile_monthly": lambda t: t.recon_monthly,
        "hourly_weather": lambda t: t.weather,
        "weather_baseline": lambda t: t.baseline,
        "weather_baseline_stats": lambda t: baseline.weather_baseline_stats(t.baseline),
        # what-if tables
        "shift_scenarios": lambda t: t.shifts,
        "shift_scenario_stats": lambda t: scenarios.shift_scenario_stats(t.shifts),
        "event_response_scenarios": lambda t: t.responses,
        "event_response_stats": lambda t: scenarios.event_response_stats(t.responses),
        # ranked summaries and questions
        "top_monthly_usage": lambda t: marts.top_monthly_usage(t.monthly),
        "peak_demand_by_meter": lambda t: marts.peak_demand_by_meter(t.peaks),
        "monthly_emissions_summary": lambda t: marts.monthly_emissions_summary(t.emissions),
        "source_usage_summary": lambda t: marts.source_usage_summary(t.monthly),
        "run_sql_reports": lambda t: t.sql_report_rows(),
        "run_sql_report_result": lambda t: t.sql_report("monthly_emissions_summary"),
        "question_table_row_count": lambda t: questions.table_row_count(t.hourly),
        "question_top_peak_demand": lambda t: questions.top_peak_demand(t.peaks),
        "question_top_monthly_usage": lambda t: questions.top_monthly_usage(t.monthly),
        "question_top_high_usage": lambda t: questions.top_high_usage(t.baseline),
        "question_events_meeting_target": lambda t: questions.events_meeting_target(t.responses),
        "question_rows_per_match_status": lambda t: questions.rows_per_match_status(t.time_varying),
        # reports
        "filter_options": lambda t: reports.filter_options(t.monthly),
        "report_monthly_usage": lambda t: reports.report_monthly_usage(t.monthly, **pick),
        "report_executive_summary": lambda t: t.executive_summary(**pick),
        "report_monthly_by_campus": lambda t: reports.report_monthly_by_campus(t.monthly, **pick),
        "report_hourly_heatmap": lambda t: reports.report_hourly_heatmap(t.hourly, **pick),
        "report_heatmap_pivot": lambda t: reports.report_heatmap_pivot(
            reports.report_hourly_heatmap(t.hourly, **pick)
        ),
        "report_top_usage_entities": lambda t: reports.report_top_usage_entities(t.hourly, **pick),
        "report_peak_demand": lambda t: reports.report_peak_demand(t.peaks, **campuses),
        "report_emissions": lambda t: reports.report_emissions(t.emissions, **pick),
        "report_emissions_assumptions": lambda t: reports.report_emissions_assumptions(t.emissions),
        "report_reconciliation": lambda t: reports.report_reconciliation(t.recon_monthly, **campuses),
        "report_baseline_summary": lambda t: reports.report_baseline_summary(t.baseline, **campuses),
        "report_actual_expected_trend": lambda t: reports.report_actual_expected_trend(t.baseline, **pick),
        "report_trend_all_sources": lambda t: reports.report_trend_all_sources(
            reports.report_actual_expected_trend(t.baseline, **pick)
        ),
        "report_candidate_rate_trend": lambda t: reports.report_candidate_rate_trend(t.baseline, **pick),
        "report_temperature_sample": lambda t: reports.report_temperature_sample(t.baseline, **pick),
        "report_top_candidates": lambda t: reports.report_top_candidates(t.baseline, **campuses),
        "report_shift_summary": lambda t: reports.report_shift_summary(t.shifts, 0.10, **campuses),
        "report_shift_comparison": lambda t: reports.report_shift_comparison(t.shifts, **pick),
        "report_shift_top": lambda t: reports.report_shift_top(t.shifts, 0.10, **campuses),
        "report_response_summary": lambda t: reports.report_response_summary(t.responses, **pick),
        "report_response_totals": lambda t: reports.report_response_totals(
            reports.report_response_summary(t.responses, **pick)
        ),
        "report_response_components": lambda t: reports.report_response_components(t.responses, **pick),
        "report_response_top": lambda t: reports.report_response_top(t.responses, **pick),
        # the same where targets are missed and limits are reached
        "event_response_stats_unmet": lambda t: scenarios.event_response_stats(t.hard_responses),
        "report_response_summary_unmet": lambda t: reports.report_response_summary(t.hard_responses, **pick),
        "report_response_totals_unmet": lambda t: reports.report_response_totals(
            reports.report_response_summary(t.hard_responses, **pick)
        ),
        "report_response_top_limited": lambda t: reports.report_response_top(t.responses, **pick, limit=4),
        "report_reconciliation_limited": lambda t: reports.report_reconciliation(t.recon_monthly, **campuses, limit=5),
        "report_temperature_sample_limited": lambda t: reports.report_temperature_sample(t.baseline, **pick, limit=700),
        # what the jobs refuse
        "failed_checks": lambda t: quality.failed_checks(t.checks),
        "event_setting_problems": lambda t: scenarios.event_setting_problems(feed.event_setting_feed(t.table("lineitem"))),
        "report_quality_summary": lambda t: quality.quality_summary(t.checks),
        # quality and profiles
        "quality_checks": lambda t: t.checks,
        "profile_table": lambda t: readable(profile.profile_table(t.bronze_building, "bronze_building_consumption")),
        "profile_documents": lambda t: readable(profile.profile_table(t.table("documents"), "documents", sample=3)),
        "timestamp_coverage": lambda t: profile.timestamp_coverage(
            t.bronze_building, "bronze_building_consumption"
        ),
        "profile_all": lambda t: readable(
            profile.profile_all({name: frame for name, (_, frame) in t.all_tables.items()})
        ),
        # documents
        "chunk_documents": lambda t: t.line_chunks,
        "chunk_pages": lambda t: t.page_chunks,
        "tokenize": lambda t: retrieval.tokenize(t.table("documents"), "doc_id").select(
            "doc_id", F.size("terms").alias("term_count"), F.array_join("terms", " ").alias("terms")
        ),
        "keyword_search_index": lambda t: t.searched(lambda index: retrieval.index_search(index, SEARCH, limit=40)),
        "keyword_search_batch": lambda t: t.searched(
            lambda index: retrieval.index_search_all(
                index, t.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), limit=3
            ).select("query_id", "rank", "score", "doc_id", "section_no", "paragraph_no", "heading")
        ),
        "keyword_search": lambda t: retrieval.keyword_search(t.line_chunks, SEARCH, id_column="doc_id"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of the session and the table folder."""

    def runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))

    registered = {name: runner(build) for name, build in operators().items()}
    if llm_queries:
        registered |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return registered


def oracle_sql() -> dict[str, str]:
    """The same results as SQL over the raw test tables."""
    statements = build_oracles(CAMPUSES, SOURCES, EVENT, SEARCH, TARGETS)
    if llm_queries:
        statements |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
