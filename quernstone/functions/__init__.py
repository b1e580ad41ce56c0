"""Column functions: text repair, guards, audit measures and hashes."""
