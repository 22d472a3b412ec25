"""streaming of the deck engine."""
