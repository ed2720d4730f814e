"""Query catalog: one query per operator, with the SQL that has to give the same rows."""
