"""Spectral-imaging analytics on Spark."""
