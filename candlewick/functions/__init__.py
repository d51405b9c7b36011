"""Column functions (no shuffles): symbols, money text, grades, calendar."""
