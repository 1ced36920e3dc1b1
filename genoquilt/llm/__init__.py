"""Training-data operators: tokenising, packing, search, de-duplication, filtering.

Nothing else in the package imports this subpackage. Each module holds one operator with a
general DataFrame-in, DataFrame-out interface; ``queries.py`` derives the registered queries.
"""
