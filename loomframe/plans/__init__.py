"""Relations derived from the star-schema tables, and the queries over them."""
