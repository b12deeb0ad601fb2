"""trackloom plans."""
