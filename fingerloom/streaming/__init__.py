"""Kept for streams; the capabilities that this engine covers have none."""
