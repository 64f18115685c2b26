"""Lectern: literature analytics as Spark DataFrame operators."""
