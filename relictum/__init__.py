"""Damage and taxonomy analytics over sequencing alignments, on Spark."""
