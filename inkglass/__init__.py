"""Inspection of files on Spark."""
