"""Relational operators, DataFrame in and DataFrame out, shared by batch and stream."""
