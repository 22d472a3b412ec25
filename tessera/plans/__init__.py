"""plans of the deck engine."""
