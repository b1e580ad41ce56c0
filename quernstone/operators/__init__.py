"""Relational operators over records, flags, votes and histories."""
