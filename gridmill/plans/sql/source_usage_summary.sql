-- Fixed values: the table and column names. Keys break ties.
SELECT source_system, count(*) AS monthly_rows, sum(total_consumption) AS total_consumption,
       sum(reading_count) AS total_readings
FROM {gold_monthly_electricity_usage}
GROUP BY source_system
ORDER BY total_consumption DESC, source_system
