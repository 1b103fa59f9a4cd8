"""Registered queries: each builds one logical plan over the test tables."""
