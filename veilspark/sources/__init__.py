"""Readers of table folders and writers of results."""
