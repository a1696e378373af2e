"""Column functions over URLs: canonical forms, routes, query parameters, file types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and MIME types of the kinds of files.
EXTENSION_KINDS = {
    "pdf": "pdf", "doc": "word", "docx": "word", "rtf": "word", "odt": "word", "xls": "excel", "xlsx": "excel", "ods": "excel",
    "csv": "csv", "ppt": "powerpoint", "pptx": "powerpoint", "odp": "powerpoint", "txt": "text", "zip": "archive", "rar": "archive",
    "7z": "archive", "mp3": "audio", "wav": "audio", "m4a": "audio", "ogg": "audio", "mp4": "video", "mkv": "video", "avi": "video",
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "webp": "image",
}
MIME_KINDS = {
    "application/pdf": "pdf", "application/msword": "word",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word", "application/rtf": "word", "application/vnd.oasis.opendocument.text": "word",
    "application/vnd.ms-excel": "excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel",
    "application/vnd.ms-powerpoint": "powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "powerpoint",
    "application/zip": "archive", "application/x-rar-compressed": "archive", "application/x-7z-compressed": "archive",
    "text/plain": "text", "text/csv": "csv", "audio/mpeg": "audio", "audio/wav": "audio", "video/mp4": "video", "image/jpeg": "image", "image/png": "image",
}
EXTENSION = r"(?i)\.(" + "|".join(sorted(EXTENSION_KINDS, key=lambda e: (-len(e), e))) + r")(?:$|[?#])"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _parts(url: Column | str) -> tuple[Column, Column, Column, Column]:
    u = _c(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    return tuple(F.regexp_extract(u, pattern, i) for i in (1, 2, 3, 4))  # type: ignore[return-value]


def canonical(url: Column | str, kinds: tuple[str, ...] = ("childs/show", "parent", "childs", "show"), keep_page: bool = False) -> Column:
    """Lower scheme and host, single slashes, no slug after an id, no query (but a numeric page if asked), no fragment."""
    scheme, host, path, query = _parts(url)
    path = F.regexp_replace(path, "/{2,}", "/")
    for k in kinds:
        path = F.regexp_replace(path, rf"(/{k}/\d+)(?:/.*)?$", "$1")
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    out = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path)
    if keep_page:
        page = F.regexp_extract(query, r"(?:^|&)(page=\d+)(?:&|$)", 1)
        out = F.when(page != "", F.concat(out, F.lit("?"), page)).otherwise(out)
    return F.when(scheme != "", out)


def route(url: Column | str, host: str, section: str, patterns: list[tuple[str, str, str]], prefix: str = "") -> Column:
    """struct(node_type, subtype, numeric_id, node_id) of the first pattern that the decoded path has; else NULL."""
    _, h, path, _ = _parts(canonical(url))
    decoded = F.try_url_decode(path)
    made = []
    for node_type, subtype, pattern in patterns:
        number = F.regexp_extract(decoded, pattern, 1) if re.compile(pattern).groups else F.lit(None).cast("string")
        number = F.when(number != "", number)
        if node_type == "index":
            node = F.lit(f"{prefix}index:{subtype}")
        elif node_type == "document":
            node = F.concat(F.lit(f"{prefix}document:{subtype}:"), number)
        else:
            node = F.concat(F.lit(f"{prefix}{node_type}:"), number)
        made.append((decoded.rlike(pattern), F.struct(F.lit(node_type).alias("node_type"), F.lit(subtype).alias("subtype"), number.alias("numeric_id"), node.alias("node_id"))))
    out = F.when(*made[0])
    for when, value in made[1:]:
        out = out.when(when, value)
    return F.when((F.lower(h) == host.lower()) & decoded.contains(section), out)


def parameter(url: Column | str, name: str) -> Column:
    return F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(name))


def with_parameter(url: Column | str, name: str, value: Column) -> Column:
    u = _c(url)
    pair = F.concat(F.lit(f"{name}="), value.cast("string"))
    replaced = F.regexp_replace(u, F.lit(rf"([?&]){name}=[^&#]*"), F.concat(F.lit("$1"), pair))
    added = F.concat(u, F.when(F.instr(u, "?") > 0, F.lit("&")).otherwise(F.lit("?")), pair)
    return F.when(u.rlike(rf"[?&]{name}="), replaced).otherwise(added)


def same_origin(a: Column | str, b: Column | str) -> Column:
    (s1, h1, _, _), (s2, h2, _, _) = _parts(a), _parts(b)
    return (F.lower(s1) == F.lower(s2)) & (F.lower(h1) == F.lower(h2))


def extension(url: Column | str, disposition: Column | None = None) -> Column:
    _, _, path, _ = _parts(url)
    own = F.regexp_extract(F.coalesce(F.try_url_decode(path), F.lit("")), EXTENSION, 1)
    if disposition is not None:
        given = F.regexp_extract(F.coalesce(disposition, F.lit("")), EXTENSION, 1)
        own = F.when(given != "", given).otherwise(own)
    return F.when(own != "", F.lower(own))


def file_kind(url: Column | str, mime: Column | str) -> Column:
    """By extension, then by MIME type, then by its first part, else unknown."""
    table = lambda t: F.create_map(*[F.lit(v) for kv in t.items() for v in kv])
    m = F.lower(F.trim(F.split(F.coalesce(_c(mime), F.lit("")), ";")[0]))
    first = F.split(m, "/")[0]
    return F.coalesce(
        F.try_element_at(table(EXTENSION_KINDS), extension(url)), F.try_element_at(table(MIME_KINDS), m),
        F.when(first.isin("audio", "video", "image"), first), F.lit("unknown"),
    )
