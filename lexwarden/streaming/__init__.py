"""Lexwarden streaming."""
