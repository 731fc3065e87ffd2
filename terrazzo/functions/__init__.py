"""Scalar geometry: Column expressions on vertex arrays, numpy kernels, and their Arrow UDFs."""
