"""Session, checkpoint and query-plan helpers."""
