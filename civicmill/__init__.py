"""Civic data analytics as Spark jobs: DataFrames in, DataFrames out."""
