"""Messaging-telemetry analytics on Spark."""
