"""How plans are cut and repeated: work tables and fixpoint loops."""
