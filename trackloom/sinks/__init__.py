"""trackloom sinks."""
