"""veilspark: personal data in text at scale, found and replaced with stable, reversible placeholders."""
