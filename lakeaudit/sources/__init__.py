"""Readers, generated manifests and sinks."""
