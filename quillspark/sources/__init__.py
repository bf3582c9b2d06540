"""Readers of folders, tables as text, journals and rules."""
