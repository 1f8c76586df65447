"""String functions, Column to Column, inside the JVM. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of C's isspace.
SPACE = r"[ \t\n\x0B\f\r]"
HASH_LENGTH = 6
TERM_LENGTH = 230


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def extract_field(text: Column, start: str, end: str, any_of_end: bool = False) -> Column:
    """The text between two markers. Without a start it begins at the beginning, without an end it goes to the end; a
    marker that is missing in the text gives nothing. any_of_end: the first of end's characters ends it."""
    rest = text if not start else F.when(F.contains(text, F.lit(start)), F.substr(text, F.instr(text, start) + len(start)))
    if end:
        if any_of_end:
            cut = F.least(*[F.coalesce(F.nullif(F.locate(c, rest), F.lit(0)), F.lit(1 << 30)) for c in sorted(set(end))], F.lit(1 << 30))
        else:
            cut = F.coalesce(F.nullif(F.instr(rest, end), F.lit(0)), F.lit(1 << 30))
        rest = F.when(cut < (1 << 30), F.substr(rest, F.lit(1), cut - 1))
    return F.when(text.isNotNull(), F.coalesce(rest, F.lit("")))


def replace_substring(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def remove_quotes(text: Column) -> Column:
    """What stands between quotes that begin the text (nothing if they aren't closed), else the first word."""
    quoted = lambda q: F.when(F.length(text) > F.length(F.replace(text, F.lit(q))) + 1, F.element_at(F.split(text, q), 2)).otherwise(F.lit(""))
    return F.when(text.startswith('"'), quoted('"')).when(text.startswith("'"), quoted("'")).otherwise(F.substring_index(text, " ", 1))


def _bytes(binary: Column) -> Column:
    """ARRAY<BIGINT> of a binary value's bytes."""
    n = F.octet_length(binary)
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return let(F.hex(binary), lambda digits: F.transform(at, lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")))


def _hash(binary: Column) -> Column:
    h = F.aggregate(_bytes(binary), F.lit(1).cast("long"), lambda acc, b: (acc * 33 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
    # digits of six bits, the lowest first, as long as any is left
    digit = lambda h, k: F.when((h == 0) | (F.shiftright(h, 6 * k) > 0), F.char(F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)) + 33)).otherwise(F.lit(" "))
    return let(h, lambda x: F.concat(*[digit(x, k) for k in range(HASH_LENGTH)]))


def hash_string(text: Column) -> Column:
    """Six characters that stand for a text's bytes; nothing for an empty text."""
    return F.when(text == "", F.lit("")).otherwise(_hash(F.encode(text, "UTF-8")))


def hash_to_length(text: Column, length: int) -> Column:
    """At most so many bytes: the first ones, then the hash of all others. A character that the cut would break is
    left out with the bytes before the cut."""
    raw, keep = F.encode(text, "UTF-8"), length - HASH_LENGTH
    head = F.regexp_replace(F.try_to_binary(F.hex(F.substring(raw, 1, keep)), F.lit("hex")).cast("string"), "�+$", "")
    return F.when(F.octet_length(text) <= length, text).otherwise(F.concat(head, _hash(F.substring(raw, keep + 1, 1 << 30))))


def limit_term(term: Column, unique: bool = False) -> Column:
    """A term of at most TERM_LENGTH bytes: cut, or (unique) with a hash of what is cut."""
    if unique:
        return hash_to_length(term, TERM_LENGTH)
    cut = F.substring(F.encode(term, "UTF-8"), 1, TERM_LENGTH).cast("string")
    return F.when(F.octet_length(term) <= TERM_LENGTH, term).otherwise(F.regexp_replace(cut, "�+$", ""))


def is_binary(text: Column) -> Column:
    """Whether any of the first 100 bytes isn't ASCII."""
    return F.hex(F.substring(F.encode(text, "UTF-8"), 1, 100)).rlike("^(?:..)*?[89A-F]")


def is_directory(mime: Column) -> Column:
    return F.contains(mime, F.lit("x-directory"))


def words_default(text: Column) -> Column:
    """Terms of the mode in which every ASCII character but letters and digits breaks, dots included."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "), " "), lambda x: x != "")


def segments(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def record_field(record: Column, name: str) -> Column:
    """The value of a key of a newline-separated record; nothing if it isn't there."""
    return extract_field(F.concat(F.lit("\n"), record, F.lit("\n")), f"\n{name}=", "\n")


def serialize(fields: dict[str, Column]) -> Column:
    """key=value lines; backslashes and line feeds of the values are escaped, null is empty."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), safe(c)) for k, c in fields.items()])


def deserialize(text: Column, name: str) -> Column:
    value = record_field(text, name)
    return F.replace(F.replace(F.replace(value, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
