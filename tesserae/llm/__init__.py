"""Operators that a training-data pipeline needs: ten of them, one module each.

Nothing outside this folder imports it; ``queries.py`` registers the contract queries.
"""
