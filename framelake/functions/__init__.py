"""Column functions over pixels kept as arrays, numbers, names and times."""
