"""Readers and derived input views."""
