"""Sets kept up to date by streams."""
