"""Registered queries, their SQL, and the stage runner."""
