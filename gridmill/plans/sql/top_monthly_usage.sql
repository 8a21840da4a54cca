-- Fixed values: the table and column names. Keys break ties.
SELECT * FROM {gold_monthly_electricity_usage}
ORDER BY total_consumption DESC, usage_month, campus_id, source_system
LIMIT 20
