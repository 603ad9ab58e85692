"""What is known about personal data (registry) and how one text is examined."""
