"""Readers, format detection, manifests and shared-storage helpers."""
