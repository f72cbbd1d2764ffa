"""Readers and writers of RDF and relational data."""
