"""Structured Streaming jobs over append-only logs; each equals its batch twin."""
