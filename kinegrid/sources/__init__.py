"""Readers, writers and adapters from the test tables to the library's schemas."""
