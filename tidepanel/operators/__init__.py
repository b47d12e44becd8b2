"""Table operators over bar panels, lifecycle tables and evidence tables."""
