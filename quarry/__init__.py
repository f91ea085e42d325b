"""quarry: a Spark-native document analytics engine."""
