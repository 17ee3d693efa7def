"""Readers and writers of correction corpora."""
