"""Column functions: text scalars, the lexicon classifier, the text query language."""
