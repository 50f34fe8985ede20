"""Readers and writers of the file formats of an evaluation run."""
