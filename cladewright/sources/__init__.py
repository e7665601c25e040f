"""Readers and writers of the domain's files, on any file system that Spark reads."""
