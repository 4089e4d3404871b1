"""Schemas of the tables that sources give and operators take."""

from __future__ import annotations

READS = "ordinal long, name string, seq string, qual string"
READ_PAIRS = "ordinal long, name string, seq1 string, qual1 string, seq2 string, qual2 string, barcodes array<struct<seq:string,qual:string>>"
ALIGNMENTS = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
SAF = "GeneID string, Chr string, Start int, End int, Strand string"
BARCODES = "cell_id string, barcode string, ord int"
FRAGMENTS = "seqnames string, start int, end int, barcode string, count int"
REGIONS = "seqnames string, start int, end int"
COUNTS = "feature string, cell string, n long"
