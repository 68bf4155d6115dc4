"""Policies, their DDL, admission of queries and the rewrite to private plans."""
