"""Operators that Spark lacks: partition transforms, predicates for pruning, star-join bounds."""
