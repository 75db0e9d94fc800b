"""Operators that prepare text, page and picture tables for model training.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface, the query that applies it to its table and,
where SQL can say the same, the SQL text.
"""
