"""Verified-knowledge analytics as lazy Spark DataFrame operators."""
