"""Table views, registered queries and their SQL twins."""
