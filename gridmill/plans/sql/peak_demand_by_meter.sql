-- Fixed values: the table and column names. Keys break ties.
SELECT * FROM {gold_peak_demand} ORDER BY peak_demand_kw DESC, campus_id, meter_id LIMIT 20
