"""Statement folders and observation tables as streams."""
