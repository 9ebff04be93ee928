"""Named queries over a folder of tables, and the SQL that checks them."""
