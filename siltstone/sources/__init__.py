"""Readers, snapshot diffs and mirrors."""
