"""Trace analytics on Spark DataFrames: cost, errors, evals, loops, diffs, redaction and KPIs."""
