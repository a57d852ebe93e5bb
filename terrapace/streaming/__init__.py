"""Streaming sources of change."""
