"""plans of braidlake."""
