"""Table schemas of the pipeline, as DDL strings."""

PAGES = "celex string, page int, text string"
META = "celex string, title string, pdf_url string"
PARSED = (
    "celex string, title string, date string, recitals array<string>, "
    "articles array<struct<number:int,heading:string,text:string>>, full_text string"
)
CHUNKS = "chunk_id string, celex string, doc_title string, chunk_type string, unit_number int, part int, heading string, text string"
ENTITY = "struct<text:string,type:string>"
RELATION = "struct<subject:string,relation:string,object:string>"
EXTRACTIONS = f"seq bigint, chunk_id string, entities array<{ENTITY}>, relations array<{RELATION}>"
ENTITY_REVIEW = "chunk_id string, chunk_text string, entity_text string, entity_type string, is_correct string, corrected_type string, notes string"
RELATION_REVIEW = "chunk_id string, chunk_text string, subject string, relation string, object string, is_correct string, notes string"
