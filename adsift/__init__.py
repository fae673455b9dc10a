"""Spark-native screening of job postings for fraud."""
