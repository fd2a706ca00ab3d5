"""Training-data operators over large text and vector tables."""
