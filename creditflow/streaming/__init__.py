"""Scoring of application streams."""
