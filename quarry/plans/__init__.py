"""Index state as a fold over a log of commits, and the ingestion job."""
