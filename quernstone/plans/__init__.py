"""Whole plans put together from operators: corpus preparation, audits, edits, evaluation."""
