"""trackloom: multi-camera trajectory analytics as Spark jobs."""
