"""operators of the corvane engine."""
