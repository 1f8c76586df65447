"""MIME types by override, extension and first bytes, and their parents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "application/octet-stream"
#: Registered types by file extension.
EXTENSIONS = {
    "txt": "text/plain", "text": "text/plain", "log": "text/plain", "md": "text/markdown", "csv": "text/csv", "rtf": "application/rtf",
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "xml": "application/xml", "rss": "application/rss+xml",
    "atom": "application/atom+xml", "svg": "image/svg+xml", "json": "application/json", "js": "text/javascript", "c": "text/x-csrc", "h": "text/x-chdr",
    "cpp": "text/x-c++src", "py": "text/x-python", "sh": "application/x-shellscript", "tex": "text/x-tex", "mbox": "application/mbox", "eml": "message/rfc822",
    "tar": "application/x-tar", "gz": "application/gzip", "tgz": "application/x-compressed-tar", "bz2": "application/x-bzip2", "zip": "application/zip",
    "a": "application/x-archive", "deb": "application/vnd.debian.binary-package", "iso": "application/x-cd-image", "pdf": "application/pdf", "ps": "application/postscript",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "odt": "application/vnd.oasis.opendocument.text",
    "chm": "application/x-chm", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "tiff": "image/tiff", "bmp": "image/bmp",
    "mp3": "audio/mpeg", "ogg": "audio/ogg", "flac": "audio/flac", "wav": "audio/x-wav", "mp4": "video/mp4", "avi": "video/x-msvideo",
}
#: First bytes, in hex, by type.
MAGIC = {
    "255044462D": "application/pdf", "25215053": "application/postscript", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif",
    "1F8B": "application/gzip", "425A68": "application/x-bzip2", "504B0304": "application/zip", "213C617263683E0A": "application/x-archive",
    "494433": "audio/mpeg", "4F676753": "audio/ogg", "664C6143": "audio/flac", "49545346": "application/x-chm", "7B5C727466": "application/rtf",
}
#: What a type is besides itself.
PARENTS = {
    "text/html": ["text/plain"], "application/xhtml+xml": ["application/xml"], "application/xml": ["text/plain"], "text/xml": ["application/xml"],
    "application/rss+xml": ["application/xml"], "application/atom+xml": ["application/xml"], "image/svg+xml": ["application/xml"],
    "application/json": ["text/plain"], "text/markdown": ["text/plain"], "text/csv": ["text/plain"], "text/css": ["text/plain"], "text/javascript": ["text/plain"],
    "text/x-csrc": ["text/plain"], "text/x-chdr": ["text/x-csrc"], "text/x-c++src": ["text/x-csrc"], "text/x-python": ["text/plain"],
    "application/x-shellscript": ["text/plain"], "text/x-tex": ["text/plain"], "application/mbox": ["text/plain"], "message/rfc822": ["text/plain"],
    "application/x-compressed-tar": ["application/gzip"], "application/vnd.debian.binary-package": ["application/x-archive"],
}


def by_extension(file: Column) -> Column:
    """Null for a name without a known extension."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.when(F.contains(file, F.lit(".")), F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index(file, ".", -1))))


def by_content(content: Column) -> Column:
    """By the first bytes; text without control characters is plain. Null for no content, or for what isn't known."""
    head = F.hex(F.substring(content, 1, 512))
    out = F.when(F.substring(content, 258, 5) == F.lit(b"ustar"), "application/x-tar")
    for prefix, mime in MAGIC.items():
        out = out.when(head.startswith(prefix), mime)
    low = F.lower(F.ltrim(F.substring(content, 1, 512).cast("string")))
    out = out.when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html").when(low.startswith("<?xml"), "application/xml").when(low.startswith("from "), "application/mbox")
    controls = head.rlike(r"^(?:..)*?(?:0[0-8BEF]|1[0-9A-F]|7F)")
    return out.when((F.octet_length(content) > 0) & ~controls, "text/plain")


def mime_type(file: Column, content: Column | None = None, protocol: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """An override by the name's end, then the extension, then the content; http without any is HTML, all else unknown.
    overrides: type by the end of the name."""
    found = [F.when(file.endswith(end), mime) for end, mime in (overrides or {}).items()] + [by_extension(file)]
    if content is not None:
        found.append(by_content(content))
    if protocol is not None:
        found.append(F.when(protocol.isin("http", "https"), "text/html"))
    return F.coalesce(*found, F.lit(UNKNOWN))


def ancestors(mime: str) -> list[str]:
    """The types that a type also is, the nearest first, itself left out."""
    out = []
    for p in PARENTS.get(mime, []):
        out += [x for x in (p, *ancestors(p)) if x not in out]
    return out


def parents(mime: Column) -> Column:
    pairs = [x for m in PARENTS for x in (F.lit(m), F.array(*[F.lit(a) for a in ancestors(m)]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mime), F.array().cast("array<string>"))
