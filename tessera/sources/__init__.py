"""sources of the deck engine."""
