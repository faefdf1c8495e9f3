"""Sources and sinks: CSV / Parquet tables, series and hyperparameter tables."""
