"""Operators over ordered sequences of messages."""
