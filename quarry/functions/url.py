"""URL, path and record functions, Column to Column. Missing parts are empty strings, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.strings import let

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
#: The bytes besides ASCII letters and digits that stay as they are in an escaped URL.
SAFE = "!$&'()*,-./:;=?@_~"


def parts(url: Column) -> Column:
    """STRUCT protocol, host, location, file, parameters. Without :// it is a file; ports stay in the host."""
    has = url.rlike(SCHEME)
    protocol = F.when(has, F.lower(F.regexp_extract(url, SCHEME, 1))).otherwise(F.lit("file"))
    rest = F.regexp_replace(url, SCHEME, "")
    local = protocol == "file"
    bare = F.when(local, rest).otherwise(F.substring_index(rest, "?", 1))
    parameters = F.when(~local & F.contains(rest, F.lit("?")), F.substr(rest, F.locate("?", rest) + 1)).otherwise(F.lit(""))
    host = F.when(local, F.lit("localhost")).otherwise(F.regexp_replace(F.substring_index(bare, "/", 1), r"^[^@]*@", ""))
    path = F.when(local, bare).otherwise(F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, r"^[^/]*/", "")).otherwise(F.lit("")))
    file = F.substring_index(path, "/", -1)
    location = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.struct(protocol.alias("protocol"), host.alias("host"), location.alias("location"), file.alias("file"), parameters.alias("parameters"))


def canonical(url: Column) -> Column:
    """Host in lower case; the slash at the end of a directory goes, that of a bare host stays."""
    low = F.concat(F.lower(F.regexp_extract(url, r"^(\w+://[^/?]*)", 1)), F.regexp_replace(url, r"^\w+://[^/?]*", ""))
    return F.regexp_replace(low, r"^(\w+://[^/]+/.+)/$", "$1")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1), "^.*@", ""))


def credentials(url: Column) -> Column:
    """STRUCT user, password of a URL; empty where there are none."""
    info = F.regexp_extract(url, r"^\w+://([^/?#@]*)@", 1)
    password = F.when(F.contains(info, F.lit(":")), F.regexp_replace(info, "^[^:]*:", "")).otherwise(F.lit(""))
    return F.struct(F.substring_index(info, ":", 1).alias("user"), password.alias("password"))


def reduce_host(host: Column, levels: int) -> Column:
    """The last labels of a host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.array_join(F.slice(labels, F.greatest(n - levels + 1, F.lit(1)), F.lit(levels)), ".")


def escape(text: Column) -> Column:
    """Percent escapes of UTF-8 bytes, upper-case hex, but for letters, digits and SAFE."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in SAFE:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def unescape(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def extension(file: Column) -> Column:
    return F.when(F.contains(file, F.lit(".")), F.lower(F.substring_index(file, ".", -1))).otherwise(F.lit(""))


def mime_class(mime: Column) -> Column:
    return F.substring_index(F.substring_index(mime, ";", 1), "/", 1)


def strip_markup(text: Column) -> Column:
    """Tags become a space, then the common entities are decoded (the ampersand last)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return out


def record(url: Column, title: Column, mime: Column, size: Column) -> Column:
    """A newline key=value record; a title that holds a reserved key loses its equals signs. Null is empty."""
    url, title, mime, size = (F.coalesce(c.cast("string"), F.lit("")) for c in (url, title, mime, size))
    clash = title.rlike(r"(?i)(url|ipath|sample|caption|type|modtime|language|size)=")
    caption = F.when(clash, F.replace(title, F.lit("="), F.lit(" "))).otherwise(title)
    return F.concat(F.lit("url="), url, F.lit("\nipath=\nsample=\ncaption="), caption, F.lit("\ntype="), mime, F.lit("\nsize="), size)


def prettify(url: Column, longest: int) -> Column:
    """At most about so many characters: a long directory is cut at its end, else the middle is; of no characters the host
    is left."""
    over = F.length(url) - longest

    def pretty(x: Column) -> Column:
        p, c = x["p"], x["c"]
        remote = F.when(p["protocol"] == "file", F.lit("")).otherwise(p["host"])
        user = F.when(c["user"] != "", F.concat(c["user"], F.lit(":"), c["password"])).otherwise(F.lit(""))
        head = F.concat(p["protocol"], F.lit("://"), user, remote, F.lit("/"))
        bare = F.concat(p["protocol"], F.lit("://"), remote, F.lit("/..."))
        location = F.length(p["location"])
        shorter = F.concat(head, F.substr(p["location"], F.lit(1), location - over - 3), F.lit(".../"), p["file"])

        def middle(whole: Column) -> Column:
            at = F.floor(F.greatest(F.length(whole) - over, F.lit(0)) / 2).cast("int")
            return F.concat(F.substr(whole, F.lit(1), at), F.lit("..."), F.substr(whole, at + over + 1))

        cut = let(F.concat(head, p["location"], F.lit("/"), p["file"]), middle)
        return F.when(over <= 0, url).when(F.lit(longest <= 0), bare).when(location > over + 3, shorter).otherwise(cut)

    return let(F.struct(parts(url).alias("p"), credentials(url).alias("c")), pretty)


def _parent(path: Column) -> Column:
    up = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/*[^/]*$", "")
    return F.when(F.contains(path, F.lit("/")), F.when(up == "", F.lit("/")).otherwise(up)).otherwise(F.lit("."))


def resolve_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, with . and .. resolved; nothing without a folder."""
    steps = F.split(F.regexp_replace(relative, "/$", ""), "/")
    walk = lambda at, x: F.when(x == "..", _parent(at)).when(x == ".", at).otherwise(F.concat(F.regexp_replace(at, "/$", ""), F.lit("/"), x))
    return F.when(folder == "", F.lit("")).otherwise(F.aggregate(steps, folder, walk))


def result_url(query_url: Column, url: Column) -> Column:
    """The URL of a result of a web engine: relative ones are of the engine's host; a URL inside one of the engine's own
    domain (a redirector's) is what counts; then canonical."""
    base = let(parts(query_url), lambda engine: F.concat(engine["protocol"], F.lit("://"), engine["host"]))
    full = F.when(url.startswith("/"), F.concat(base, url)).when(url.startswith("./"), F.concat(base, F.substr(url, F.lit(2)))).when(url.rlike(SCHEME), url).otherwise(F.concat(base, F.lit("/"), url))

    def unwrapped(own: Column) -> Column:
        rest = F.regexp_extract(own, r"^\w+://.*?((?:https?|ftp)(?::|%3[Aa]).*)$", 1)
        same = reduce_host(host_of(query_url), 2) == reduce_host(host_of(own), 2)
        return canonical(F.trim(F.when(same & (rest != ""), unescape(F.substring_index(rest, "&amp;", 1))).otherwise(own)))

    return F.when(url == "", F.lit("")).otherwise(let(full, unwrapped))
