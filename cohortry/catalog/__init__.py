"""Every registered query with the SQL that checks it."""
