"""Operators for preparing language-model training data on Spark.

Thirteen operators (sharding, fingerprints, HTML extraction, source mixing,
quality scoring, URL lists, token files, media columns, n-gram joins, packing,
vector clusters, near duplicates, spelling variants).  Each
module documents its own method, parameters and defined results for odd input.
Nothing outside this package imports it.
"""
