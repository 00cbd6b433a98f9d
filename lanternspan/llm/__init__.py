"""Training-data operators over documents, chunks, span annotations and held-out items.

Nothing outside this package imports it. Every operator takes and returns DataFrames, selects the columns it
needs first (extra or clashing columns of the input never reach it) and states what nulls and empty texts give.
"""
