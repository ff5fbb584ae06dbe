"""Record-at-a-time processing of line documents."""
