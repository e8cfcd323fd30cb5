"""A case view over the star-schema test tables, its queries, and their SQL twins."""
