"""functions of braidlake."""
