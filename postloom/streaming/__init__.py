"""Jobs over files that keep arriving."""
