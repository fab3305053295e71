"""sources of the corvane engine."""
