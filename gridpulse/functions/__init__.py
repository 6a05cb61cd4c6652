"""Column functions: calendar keys, rounding, class ladders, geometry, subspace arithmetic."""
