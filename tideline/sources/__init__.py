"""Recordings: containers, message definitions, payloads, and the data sources on them."""
