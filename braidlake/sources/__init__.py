"""sources of braidlake."""
