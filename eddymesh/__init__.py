"""Queries over gridded simulation fields, on Spark."""
