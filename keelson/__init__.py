"""keelson."""
