"""Writers of reports, FASTA and charts."""
