"""Sources and sinks of survey tables."""
