"""Map and write operators as pure DataFrame functions."""
