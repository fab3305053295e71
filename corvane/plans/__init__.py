"""plans of the corvane engine."""
