"""Readers and writers: JSON feeds, snapshot folders, tables, manifests."""
