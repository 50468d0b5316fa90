"""Structural segmentation of ordered data on Spark."""
