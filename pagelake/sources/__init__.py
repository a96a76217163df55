"""Readers of files and archives as rows."""
