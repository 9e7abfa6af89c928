"""Recorded-call analytics as Spark DataFrame operators."""
