"""Readers, writers and keyed table stores."""
