"""The registered queries and the views of the given tables they run on."""
