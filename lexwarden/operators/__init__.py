"""Lexwarden operators."""
