"""Spark-native analytics: cohort pooling, statistics, profiles and training-data operators."""
