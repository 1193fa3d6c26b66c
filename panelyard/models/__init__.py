"""Regression and mixed models fitted from per-group sums computed by Spark."""
