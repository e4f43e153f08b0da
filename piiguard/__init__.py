"""piiguard: detection, redaction and validation of personal data in pages and documents, on Spark."""
