"""Readers, landed-payload scans, validators and sinks."""
