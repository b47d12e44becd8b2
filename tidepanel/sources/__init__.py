"""Readers for saved files and writers for stages."""
