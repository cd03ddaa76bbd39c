"""Readers, writers, model registry and integrity checks."""
