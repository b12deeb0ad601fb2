"""trackloom operators."""
