"""Spark-native engine for turning page text into books, and a text-corpus toolkit beside it."""
