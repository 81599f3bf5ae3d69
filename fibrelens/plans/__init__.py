"""Whole reports made of several operators, and the mapping used by the checks."""
