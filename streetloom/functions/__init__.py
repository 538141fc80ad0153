"""Scalar functions: well-known binary geometry, projections, distances."""
