"""Input tables and saved rules."""
