"""Readers, writers and profiles."""
