"""Training-data operators: filtering, deduplication, labelling, mixing and packing of documents.

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
