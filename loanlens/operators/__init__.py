"""The analyses and the steps they are made of."""
