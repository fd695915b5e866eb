"""Column helpers and partition kernels shared by the operators."""
