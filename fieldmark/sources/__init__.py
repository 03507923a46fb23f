"""Readers with declared schemas, sinks and positional row keys."""
