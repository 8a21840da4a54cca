"""Table-to-table jobs: DataFrames and parameters in, a lazy DataFrame out."""
