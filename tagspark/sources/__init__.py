"""Reading items, sheets, records and vocabularies; writing results."""
