"""Training-data operators: sharding, deduplication, decontamination, scoring, filtering, packing.

Every operator takes DataFrames and returns DataFrames. Nothing outside this
subpackage imports it.
"""
