"""The registered queries over the test tables, and the SQL that states their results."""
