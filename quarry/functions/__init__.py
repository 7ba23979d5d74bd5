"""Column functions: points, distances, value coercion."""
