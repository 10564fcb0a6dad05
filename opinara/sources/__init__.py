"""Readers, landed-payload mappers and sinks."""
