"""Training-data operators: extraction, classification, deduplication, tokenisation, sharding, search.

Each module holds one operator and its thin ``opN_<name>`` query.  ``registry`` lists the queries.
Nothing outside this subpackage imports it.
"""
