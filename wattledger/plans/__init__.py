"""Composed jobs: the table bindings, the registered queries and their check SQL."""
