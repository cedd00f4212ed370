"""Spark-native microsatellite population-genetics analytics."""
