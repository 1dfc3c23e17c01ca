"""Operators for preparing training data; each module holds one method and its query."""
