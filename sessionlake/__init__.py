"""sessionlake: Spark-native analytics over agent-session history and training-data pipelines."""
