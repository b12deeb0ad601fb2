"""trackloom streaming."""
