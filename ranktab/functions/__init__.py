"""Column-level building blocks: each returns a Column, none runs a job."""
