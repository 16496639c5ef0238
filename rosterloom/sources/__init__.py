"""Readers and writers of roster files."""
