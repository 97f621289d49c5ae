"""Event streams and live monitoring."""
