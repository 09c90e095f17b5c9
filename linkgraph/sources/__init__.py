"""Sources and sinks: archives, match files, name tables."""
