"""Sources and sinks: file imports, the test-data adapter and the Parquet silver layer."""
