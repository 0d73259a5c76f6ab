"""Names, values and scalar functions of the query language."""
