"""Operators of a training-data pipeline: dedup, scoring, mixing, packing, token files, search.

Each module holds one operator with a general interface over a DataFrame;
``queries`` registers the thin ``opN_<name>`` queries over the given tables.
Nothing outside this subpackage imports it.
"""
