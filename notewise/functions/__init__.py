"""Column-level functions: text cleaning, vector maths, small driver-side statistics."""
