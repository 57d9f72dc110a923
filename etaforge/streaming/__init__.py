"""Structured Streaming jobs. Sources are file streams; every sink is idempotent per batch."""
