"""auditframe: judge result sets, query logs, corpora, catalogs and marts with Spark DataFrames."""
