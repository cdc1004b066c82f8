"""Scoring on Structured Streaming inputs."""
