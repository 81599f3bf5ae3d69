"""Business operators, grouped by subject."""
