"""Fields, timestamps and the format probe."""
