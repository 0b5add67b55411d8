"""Queries with their SQL, and the audit plan."""
