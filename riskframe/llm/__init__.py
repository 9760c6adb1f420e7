"""Operators of a training-data pipeline over whole text tables.

One module per operator; ``queries`` registers them with their SQL. Every
operator takes a DataFrame and column names, so it runs on any table of that
shape; the queries only pick the given tables and parameters.
"""
