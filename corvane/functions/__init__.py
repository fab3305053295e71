"""functions of the corvane engine."""
