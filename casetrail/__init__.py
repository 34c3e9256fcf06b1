"""Spark-native analytics for clinical literature: extraction, figures, merge, quality."""
