"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it is present.
"""
