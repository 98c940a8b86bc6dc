"""Training-data operators on Spark: search, deduplication, filtering, packing and archive formats.

Nothing outside this folder imports it; deleting it leaves the rest of the library whole.
"""
