"""Part of kgspark."""
