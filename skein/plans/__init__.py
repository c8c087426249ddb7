"""Metrics views, composite plans and the registered queries."""
