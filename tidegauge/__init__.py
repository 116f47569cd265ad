"""tidegauge: a Spark-native analytics engine for pipeline-run freshness."""
