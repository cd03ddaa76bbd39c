"""Operators for training corpora: each one a Spark job of its own, imported by nothing else in the library."""
