"""Readers of statement exports, feed payloads and event logs, and idempotent sinks."""
