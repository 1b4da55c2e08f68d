"""tidegauge: relational and time-series analytics over the same data, on Spark."""
