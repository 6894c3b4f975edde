"""Training-data operators: ten operators on documents and web pages, their queries and their SQL.

Nothing else in the package imports this one.
"""
