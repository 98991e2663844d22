"""Spark-native robust implicit-surface fitting and Monte-Carlo analytics."""
