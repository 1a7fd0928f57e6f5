"""Schemas of the document tables and of the nested extraction records."""

from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType


_KINDS = {"int": IntegerType(), "long": LongType(), "string": StringType(), "array<string>": ArrayType(StringType()), "array<array<string>>": ArrayType(ArrayType(StringType()))}


def _struct(text: str) -> StructType:
    """``name kind, ...``; needs no session."""
    return StructType([StructField(f.split()[0], _KINDS[f.split()[1]]) for f in text.split(", ")])


REGULATIONS = _struct("id long, seq long, title string, category_l0 string, category_l1 string, department string, enact_date string, status string, source_pages string")
AMENDMENTS = _struct("regulation_id long, amend_date string, ordinal int")
ARTICLES = _struct("id long, regulation_id long, chapter string, section string, gwan string, no int, sub_no int, title string, body string, ordinal int")
ADDENDA = _struct("regulation_id long, line string, ordinal int")
ATTACHMENTS = _struct("regulation_id long, label string, start_page int, end_page int, lines array<string>, rows array<array<string>>, file_url string, ordinal int")
REVISIONS = _struct("id long, regulation_id long, revised_at string, summary string, created_at string")
REVISION_CHANGES = _struct("revision_id long, article_no int, article_sub_no int, article_title string, old_body string, new_body string, ordinal int")

_ARTICLE = _struct("chapter string, section string, gwan string, no string, sub_no string, title string, body string")
_ATTACHMENT = _struct("label string, lines array<string>, start_page int, end_page int, rows array<array<string>>, file_url string")

#: One regulation of a compiled edition, as the extraction writes it.
REGULATION_RECORD = StructType(
    [
        StructField("seq", LongType()),
        StructField("l0", StringType()),
        StructField("l1", StringType()),
        StructField("index_no", StringType()),
        StructField("toc_title", StringType()),
        StructField("parsed_title", StringType()),
        StructField("enact_date", StringType()),
        StructField("amend_dates", ArrayType(StringType())),
        StructField("article_count", IntegerType()),
        StructField("articles", ArrayType(_ARTICLE)),
        StructField("addenda", ArrayType(StringType())),
        StructField("attachments", ArrayType(_ATTACHMENT)),
        StructField("pdf_pages", ArrayType(IntegerType())),
    ]
)

#: One dated snapshot of all regulations.
SNAPSHOT = StructType(
    [
        StructField("date", StringType()),
        StructField("source_file", StringType()),
        StructField("regulations", ArrayType(_struct("title string, article_count int").add("articles", ArrayType(_ARTICLE)))),
    ]
)

_CHANGE = _struct("article_no int, article_sub_no int, article_title string, old_body string, new_body string, ordinal int")
SEED = _struct("regulation_seq long, revised_at string, summary string").add("changes", ArrayType(_CHANGE))

#: Committee archive: session -> title -> record.
COMMITTEE = MapType(StringType(), MapType(StringType(), _struct("title_raw string, content string, stage string, file string")))
