"""Ready-made jobs over the test tables."""
