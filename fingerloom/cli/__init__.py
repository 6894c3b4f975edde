"""Command lines of the engine."""
