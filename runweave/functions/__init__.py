"""Column functions that many operators share; built-in expressions only."""
