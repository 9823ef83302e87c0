"""Structured Streaming jobs over growing sample and event folders."""
