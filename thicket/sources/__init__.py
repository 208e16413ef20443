"""Readers and writers: relation files, configuration, captured requests, repository-wise tables."""
