"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this package imports it; it imports nothing from the rest of
the library, so either can be removed without touching the other.
"""
