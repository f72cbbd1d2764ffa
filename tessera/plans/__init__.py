"""Rules and their fixpoints."""
