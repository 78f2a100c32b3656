"""Sources and sinks of texts."""
