"""Schemas of the tables that pass between stages."""

from __future__ import annotations

CIGAR = "array<struct<op:string,len:int>>"
EXONS = "array<struct<start:int,end:int>>"
ALIGNMENTS = (
    "name string, ref string, pos int, mate_ref string, mate_pos int, insert_size int, cigar array<struct<op:string,len:int>>, "
    "qual string, is_paired boolean, is_qcfail boolean, is_mapped boolean, is_primary boolean, mate_mapped boolean, "
    "is_rev boolean, mate_rev boolean, is_first boolean, nh int, hi int, md string, arrival long"
)
GRAPHS = "graph_id string, ref string, strand string, left int, right int, read_count long"
SEGMENTS = "graph_id string, idx int, start int, end int, zero_frac double"
PATH_ROWS = "graph_id string, row int, flags array<int>, n long"
CANDIDATES = "graph_id string, subgraph string, cand_idx int, name string, ref string, strand string, length int, exons array<struct<start:int,end:int>>, is_pre_mrna boolean"
