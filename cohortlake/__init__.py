"""Spark jobs for cohorts of image-derived tables and for text corpora."""
