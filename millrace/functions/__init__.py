"""Scalar function registry and column builders."""
