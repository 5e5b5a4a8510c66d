"""Lexwarden plans."""
