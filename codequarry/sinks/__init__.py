"""Reports and tables written for others."""
