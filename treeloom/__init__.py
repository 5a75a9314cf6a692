"""Structural analytics of mathematical text on Spark."""
