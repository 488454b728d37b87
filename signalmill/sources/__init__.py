"""Readers, writers and work-identity helpers."""
