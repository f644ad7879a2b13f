"""Readers, and the shared folder for staged tables."""
