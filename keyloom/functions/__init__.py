"""Column functions: byte keys, the tuple encoding, sketches, buckets."""
