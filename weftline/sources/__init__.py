"""Readers, writers and content manifests."""
