"""Readers: derived views of the shared tables, alignments, sequences, matrices and score tables."""
