"""tidemark: time-series factors over market bars, Spark-first."""
