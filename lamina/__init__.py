"""Layered attribute records on Spark."""
