"""Column -> Column functions and driver-side column resolution."""
