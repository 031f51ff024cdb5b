"""skein: a Spark-native code-graph and text-analytics engine."""
