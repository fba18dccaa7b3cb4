"""Forecast-ledger analytics on Spark DataFrames.

The package is a set of functions from DataFrames to DataFrames.  Nothing here
triggers a job on its own: callers decide when to act, Catalyst plans the rest.
"""
