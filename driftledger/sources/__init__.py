"""Readers and writers of logs, manifests and reports."""
