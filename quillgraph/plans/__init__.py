"""Views over the driver tables and the queries over them."""
