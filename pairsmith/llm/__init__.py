"""Operators for large-scale training-text preparation.

Each module holds one operator with its own general interface; ``queries``
binds the operators to the driver's tables and ``registry`` lists them.
Nothing outside this subpackage imports it.
"""
