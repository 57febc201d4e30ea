"""Typed graph of engineering artefacts on Spark: sources, functions, operators, plans, streams."""
