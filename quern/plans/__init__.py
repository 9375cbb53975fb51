"""Composed plans: the search facade and the query catalogue."""
