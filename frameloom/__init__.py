"""frameloom: Spark-native vector matching, ordered-event gating and signal features."""
