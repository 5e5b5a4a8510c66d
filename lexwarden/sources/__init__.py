"""Lexwarden sources."""
