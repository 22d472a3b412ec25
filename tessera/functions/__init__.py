"""functions of the deck engine."""
