"""Readers of files into documents, and writers of results."""
