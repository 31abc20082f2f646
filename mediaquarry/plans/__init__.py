"""Plans shared by operators, and the queries over the tables of a folder."""
