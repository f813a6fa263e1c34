"""Variant-association and single-cell table operators for Apache Spark."""
