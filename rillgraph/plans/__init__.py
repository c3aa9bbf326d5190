"""Plan helpers shared by operators: lineage cuts, size-checked broadcasts."""
