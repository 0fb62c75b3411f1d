"""Training-data operators: ten numbered operators, each with its own module, and their queries.

Nothing else in the library imports this package; deleting it leaves the rest working.
"""
