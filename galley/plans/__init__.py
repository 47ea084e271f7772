"""User-level jobs made of operators."""
