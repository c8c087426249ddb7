"""skein: a Spark-native engine for event-trend analytics and corpus preparation."""
