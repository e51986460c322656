"""Files to rows."""
