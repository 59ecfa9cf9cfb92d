"""The registered queries and the SQL that each is compared with."""
