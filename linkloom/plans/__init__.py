"""Whole chains, and the catalogue of registered queries with their check SQL."""
