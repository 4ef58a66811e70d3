"""Column expressions: tokenization, decoding filters, schedules and numeric kernels."""
