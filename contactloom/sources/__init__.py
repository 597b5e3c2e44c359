"""Readers that map listings, pages and history to the library's schemas."""
