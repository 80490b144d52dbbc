"""Streams: column functions (textloom.functions) and similarity.blend apply to streaming DataFrames as they are.

The library keeps no state between rows, so it needs no stateful streaming operator.
"""
