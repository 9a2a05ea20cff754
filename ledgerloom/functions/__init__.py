"""Column functions and small driver-side helpers; none of them touches Python rows."""
