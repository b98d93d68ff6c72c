"""The jobs: DataFrames in, DataFrames out."""
