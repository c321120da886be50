"""Streams: rules over single records on a stream of JSON lines."""
