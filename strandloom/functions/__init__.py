"""Column functions over identifiers, sequences, alignments and intervals."""
