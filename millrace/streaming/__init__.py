"""Gates, delivery, state by key, and the running of taps and flows."""
