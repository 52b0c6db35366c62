"""Relational operators over telemetry, features and graphs."""
