"""Spark-native campaign analytics: lazy DataFrame operators over typed campaign data."""
