"""Training-data operators: extraction, fingerprints, packing, WARC derivatives, PII, similarity
joins, URL rules, embedding near-duplicates, toxicity and source mixing.

Every operator takes DataFrames and returns DataFrames.  ``queries`` registers the ``opN_*``
queries and the pipeline; nothing outside this package imports it.
"""
