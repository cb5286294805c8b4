"""Spark-native analytics over company disclosures: facts, filings, news, jobs and places."""
