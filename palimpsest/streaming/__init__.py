"""Streams: sessions, lanes, calendar windows, idempotent sinks and ordered replay."""
