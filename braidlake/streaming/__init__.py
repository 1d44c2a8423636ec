"""streaming of braidlake."""
