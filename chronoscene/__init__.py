"""Chronoscene: spatio-temporal scene-graph analytics expressed as Spark plans."""
