"""Spark-native item similarity, catalog analytics and corpus preparation."""
