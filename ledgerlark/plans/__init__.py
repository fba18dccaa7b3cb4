"""Logical plans: adapter views, the wide frame and the query catalogue."""
