"""Where bars and events come from, and where results go."""
