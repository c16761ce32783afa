"""Tolerances and sentinels shared by all geometry expressions."""

EPSILON = 1e-8
MAX_DOUBLE = 1.7976931348623157e308
ID_MODULUS = 10**18
