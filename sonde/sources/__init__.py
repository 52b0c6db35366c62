"""Readers and writers of telemetry, annotations and results."""
