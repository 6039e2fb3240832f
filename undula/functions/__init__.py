"""Scalar functions: sample conversion, companding laws, filter design and text forms of times and notes."""
