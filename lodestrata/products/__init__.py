"""End products composed from the operators."""
