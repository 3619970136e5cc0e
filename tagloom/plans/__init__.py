"""Query plans over the adapter views, and helpers that several operators share."""
