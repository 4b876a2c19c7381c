"""Readers and writers of binary files of ids, tags, queries and vectors."""
