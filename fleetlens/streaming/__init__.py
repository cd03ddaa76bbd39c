"""Replay, prequential errors, drift detectors and the lifecycle, as Structured Streaming jobs and batch twins."""
