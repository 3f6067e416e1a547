"""Structured Streaming jobs: metric and control streams, limiter, cleaning stream."""
