"""Small column and DataFrame helpers shared by the operators."""
