"""Inputs: named datasets (catalog), the claims subject tables over the test
tables (fixtures) and the CSV extract reader (files)."""
