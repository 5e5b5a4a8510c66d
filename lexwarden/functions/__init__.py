"""Lexwarden functions."""
