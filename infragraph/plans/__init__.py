"""Plan building blocks shared by the operators: lineage cuts and connected components."""
