"""Plan building blocks shared by the operators: durable cuts, size-checked broadcasts, components."""
