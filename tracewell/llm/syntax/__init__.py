"""Parsers that accept or refuse a text in one language; they build no tree."""
