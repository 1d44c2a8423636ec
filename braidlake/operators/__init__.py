"""operators of braidlake."""
