"""Readers and writers: JSON lines, aligned texts, feeds, evaluation reports, logs."""
