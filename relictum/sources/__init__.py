"""Readers and writers of alignments, taxonomies and result tables."""
