"""Data contracts for tables on Spark."""
