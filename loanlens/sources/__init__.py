"""Relations the package reads: their schemas and the built-in reference tables."""
