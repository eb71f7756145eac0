"""Operators for preparing training text: filters, deduplication, search, tokens and packing.

Nothing outside this folder imports it. Every operator is a function from DataFrames to a DataFrame; ``queries`` applies
each of them to the whole of its table.
"""
