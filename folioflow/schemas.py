"""Row types of the pipeline's tables."""

from __future__ import annotations

FORMULA = (
    "struct<id:string,number:string,latex:string,raw:string,description:string,semantic_description:string,variables:map<string,string>,"
    "variable_list:array<string>,context:string,source:string,page:int,confidence:double,type:string,extraction_method:string,link_score:double>"
)
CITATION = (
    "struct<authors:array<string>,paper_id:string,title:string,year:string,journal:string,volume:string,issue:string,pages:string,"
    "section:string,doi:string,url:string,original_doi:string>"
)
BLOCK = f"paper_id string, pos int, type string, content string, latex string, page int, pages array<int>, section string, source string, label string, formulas array<{FORMULA}>, metadata map<string,string>"
CHUNK_JSON = f"struct<chunk_id:string,content:string,type:string,section:string,source:string,search_text:string,citation:{CITATION},formulas:array<{FORMULA}>,pages:array<int>>"
KB = "struct<id:string,number:string,latex:string,description:string,context:string,variables:map<string,string>,page:int,source_type:string,confidence:double>"
#: The types of a block.
BLOCK_TYPES = ("paragraph", "section", "formula", "formula_candidate", "formula_fragment", "equation_block", "formula_label", "title", "authors", "abstract", "publication_date", "figure", "table")
FORMULA_TYPES = ("formula", "equation_block", "formula_candidate", "formula_fragment")
