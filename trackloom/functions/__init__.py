"""trackloom functions."""
