"""Named queries over the tables of a folder, each a function of (spark, folder), and the SQL that says the same."""
