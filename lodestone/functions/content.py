"""What a body is, by what was declared, by its first bytes, by its address; and parts of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types and the kind that each names.
TYPES = {
    "text/html": "html",
    "application/xhtml+xml": "html",
    "application/pdf": "pdf",
    "text/plain": "text",
    "application/json": "json",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/csv": "csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet",
    "application/vnd.ms-excel": "spreadsheet",
    "application/vnd.oasis.opendocument.spreadsheet": "spreadsheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document",
    "application/msword": "document",
    "application/vnd.ms-powerpoint": "document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "document",
    "application/vnd.oasis.opendocument.text": "document",
    "application/vnd.oasis.opendocument.presentation": "document",
    "application/rtf": "document",
    "text/rtf": "document",
    "application/epub+zip": "document",
}
# Extensions of each kind.
EXTENSIONS = {
    "html": ("html", "htm", "xhtml"),
    "pdf": ("pdf",),
    "text": ("txt", "md", "markdown"),
    "json": ("json",),
    "xml": ("xml",),
    "csv": ("csv",),
    "spreadsheet": ("xlsx", "xls", "ods"),
    "document": ("docx", "doc", "ppt", "pptx", "odt", "odp", "rtf", "epub"),
    "audio": ("m4a", "mp3", "wav", "ogg", "opus", "webm"),
    "zip-container": ("zip",),
}
# Kinds that are fetched where a page embeds them.
ENCLOSABLE = ("pdf", "document", "spreadsheet", "csv")
# What a video tool prints when it is refused, and when there is nothing to get.
REFUSED = (
    "sign in to confirm",
    "confirm you're not a bot",
    "confirm you’re not a bot",
    "http error 429",
    "too many requests",
    "blocked it in your country",
    "this video is not available from your location",
    "requested format is not available",
    "po token",
)
ABSENT = (
    "video unavailable",
    "this video has been removed",
    "private video",
    "members-only",
    "http error 404",
    "does not exist",
    "account associated with this video has been terminated",
)
# Leading bytes in hexadecimal, as a pattern, and their kind.
MAGIC = (
    (r"^255044462D", "pdf"),
    (r"^7B5C727466", "document"),
    (r"^D0CF11E0A1B11AE1", "document"),
    (r"^504B0304", "zip-container"),
    (r"^.{8}66747970|^1A45DFA3|^52494646.{8}57415645|^4F676753|^494433|^FF[EF][23ABF]", "audio"),
)


def declared_kind(content_type: Column) -> Column:
    """The kind that a content type names; null if it names none."""
    plain = F.lower(F.trim(F.split(content_type, ";")[0]))
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.when(plain.startswith("audio/"), F.lit("audio")).otherwise(F.try_element_at(known, plain))


def extension_kind(url: Column) -> Column:
    extension = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(?s)^[a-zA-Z]+://[^/]+.*/[^/]*\.([^./]+)$", 1))
    return F.coalesce(*[F.when(extension.isin(*names), kind) for kind, names in EXTENSIONS.items()])


def magic_kind(head: Column) -> Column:
    """The kind that the first bytes show; null if they show none."""
    code = F.hex(F.substring(head, 1, 16))
    text = F.lower(F.regexp_replace(F.decode(F.substring(head, 1, 256), "ISO-8859-1"), r"^\s+", ""))
    page = F.when(text.startswith("<!doctype html") | text.startswith("<html"), "html")
    return F.coalesce(*[F.when(code.rlike(pattern), kind) for pattern, kind in MAGIC], page)


def content_kind(content_type: Column, head: Column, final_url: Column) -> Column:
    """One of 13 kinds: declared, else by bytes, else by the served address, else other. JSON that holds captions is captions."""
    declared = declared_kind(content_type)
    captions = F.decode(F.substring(head, 1, 4096), "ISO-8859-1").rlike("wireMagic|tStartMs")
    seen = F.when((declared == "json") & captions, "captions").otherwise(declared)
    return F.coalesce(seen, magic_kind(head), extension_kind(final_url), F.lit("other"))


def recorded_kind(content_type: Column, final_url: Column) -> Column:
    """content_kind without the bytes."""
    return F.coalesce(declared_kind(content_type), extension_kind(final_url), F.lit("other"))


def refusal_class(message: Column) -> Column:
    """blocked, gone or error for the video tool's message; a refusal outweighs an absence."""
    said = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(message), w))
    return F.when(said(REFUSED), "blocked").when(said(ABSENT), "gone").otherwise("error")


def looks_like_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8,}$")


def is_video_id(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]{11}$")


def video_id_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit(""))


def watch_url_at(video: Column, ms: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("string"), F.lit("s"))


def is_document(path: Column) -> Column:
    """Whether the last segment of a path is a name and an extension worth fetching."""
    names = "|".join(e for kind in ENCLOSABLE for e in EXTENSIONS[kind])
    return path.rlike(rf"(?i)(^|/)[^/]+\.({names})$")


def suggested_id(host: Column) -> Column:
    """A source's name from its host: the first label that isn't www."""
    return F.regexp_replace(F.lower(F.split(F.regexp_replace(host, r"(?i)^www\.", ""), r"\.")[0]), "[^a-z0-9]", "-")


def w3c_datetime(text: Column) -> Column:
    """A full time stamp, or a bare date as midnight; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def probability_of_yes(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))
