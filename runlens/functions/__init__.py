"""Column builders: no function here needs more than the row or group it is given."""
