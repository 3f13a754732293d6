"""Tables, schemas, Parquet footers and CSV import or export."""
