"""Sources and sinks of vectors and codes."""
