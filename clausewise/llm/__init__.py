"""Training-data operators: one module per operator, `queries` registers them.

Nothing else in the package imports this subpackage.
"""
