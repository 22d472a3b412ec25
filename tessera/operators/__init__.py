"""operators of the deck engine."""
