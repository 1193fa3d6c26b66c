"""Worked examples: the epidemic, policy, coverage, spending and clinic analyses as compositions of operators."""
