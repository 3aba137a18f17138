"""Readers and writers of corpora, evaluation sets and run results."""
