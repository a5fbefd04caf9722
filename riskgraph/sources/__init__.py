"""Readers of source code, build files, histories and advisories."""
