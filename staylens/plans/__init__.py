"""Ready jobs built from the operators."""
