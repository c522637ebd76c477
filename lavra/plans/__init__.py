"""Compositions: the document pipeline, and the registered queries."""
