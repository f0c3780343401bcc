"""sources of the sequence engine."""
