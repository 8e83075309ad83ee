"""Column functions and driver-side statistics."""
