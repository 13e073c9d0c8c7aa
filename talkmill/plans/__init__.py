"""Plan helpers shared by the operators: lineage cuts, skew-safe ranks, sessions."""
