"""Spark-native reconciliation of quantitative claims, from page text to an audited relation graph."""
