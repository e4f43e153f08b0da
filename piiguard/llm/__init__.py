"""Training-data operators: ten corpus-scale components and their queries.

Nothing else in the library imports this subpackage; deleting it leaves the rest intact.
"""
