"""Readers and writers for sequence, hit and feature files."""
