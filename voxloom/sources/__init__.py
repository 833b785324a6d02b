"""Reading, preparing and writing feedback tables."""
