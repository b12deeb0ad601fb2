"""trackloom sources."""
