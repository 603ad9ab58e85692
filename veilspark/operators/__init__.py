"""DataFrame operators: detection, placeholders, rewriting, review, sessions."""
