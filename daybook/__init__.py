"""daybook: a Spark-native engine for daily demand panels and forecast evaluation."""
