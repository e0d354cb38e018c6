"""Resale-margin analytics over captured marketplace listings, on Spark."""
