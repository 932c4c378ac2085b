"""Operators for preparing training data: one module each, with `catalogue` and `oracle` for their queries."""
