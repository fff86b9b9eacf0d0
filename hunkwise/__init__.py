"""A Spark-native engine for review data: diffs, findings, documents and where each comment goes."""
