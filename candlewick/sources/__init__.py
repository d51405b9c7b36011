"""Readers that turn landed data into the bar schema."""
