"""Security-risk scanning of large tables, as functions from DataFrames to DataFrames.

The library never creates a session and never collects data outside the sinks that
say so. Callers pass DataFrames in and get DataFrames back.
"""
