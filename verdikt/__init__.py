"""Scoring, roll-up, corpus preparation and vector quantization on Spark."""
