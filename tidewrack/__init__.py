"""Spark-native engine for news items: extraction, classification, entity resolution, keyed tables and serving."""
