"""DataFrame operators over bar and feature tables (many symbols at once)."""
