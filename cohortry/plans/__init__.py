"""End-to-end studies built from the operators."""
