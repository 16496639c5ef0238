"""Rule programs and the end-to-end plan."""
