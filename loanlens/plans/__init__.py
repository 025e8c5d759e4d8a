"""Whole analyses over the benchmark tables, and their equivalents in SQL."""
