"""Training-data pipeline operators; nothing else in the library imports this subpackage.

Each module holds one operator as a DataFrame-to-DataFrame function with its own general interface.
``queries`` wraps them as registered queries over the given tables.
"""
