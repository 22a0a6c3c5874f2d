"""Structured Streaming entry points: the per-note operators are stateless
maps, so new notes can be cleaned and matched as they arrive."""
