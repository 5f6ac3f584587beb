"""Training-data operators: ten document-scale operators and their queries.

Nothing else in the library imports this subpackage.
"""
