"""Scalar functions over text columns, all within Spark's code generation. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and marks that are part of the results.
WHOLE_FILE_LINES, PREVIEW_LINES = 500, 100
EXCERPT_WHOLE, EXCERPT_HEAD, EXCERPT_TAIL = 3000, 1000, 1500
TELEMETRY_WHOLE, TELEMETRY_SIDE = 500, 250
RPC_CHARS = 8000
EXCERPT_MARK = "\n\n...[MIDDLE LOG TRUNCATED]...\n\n"
TELEMETRY_MARK = "\n...[TRUNCATED]...\n"
SOURCE_LINE_CHARS, DETAIL_CHARS, STACK_CHARS, STACK_LINES, DECOMPILED_LINES = 400, 512, 1200, 15, 500
GLOBAL_NAMESPACE = "(global namespace)"
#: Accessibilities that are shown, with their keywords.
ACCESS = {"Public": "public", "Protected": "protected", "ProtectedAndInternal": "protected internal", "ProtectedOrInternal": "protected internal"}


def lines(text: Column) -> Column:
    """Lines ended by CRLF, LF or CR, without an empty entry after the last end. The end is cut off first, so that a text is split once."""
    n = F.char_length(text)
    cut = F.when(F.endswith(text, F.lit("\r\n")), F.left(text, n - 2)).when(F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r")), F.left(text, n - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\r\n|\n|\r", -1))


def lines_kept(text: Column) -> Column:
    """Lines ended by CRLF or LF; an empty entry after the last end is kept."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def lines_physical(text: Column) -> Column:
    """CR and LF each end an entry, so CRLF yields one more."""
    return F.split(text, "[\r\n]", -1)


def trimmed(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def places(text: Column, part: str) -> Column:
    """Where a text stands in another, from 0 and without overlaps, in one pass: the running lengths of what lies between."""
    between = F.transform(F.split(text, rf"\Q{part}\E", -1), lambda x: F.char_length(x).cast("long"))
    start = F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("end"))
    step = lambda done, n: F.struct(F.array_append(done["at"], done["end"] + n).alias("at"), (done["end"] + n + len(part)).alias("end"))
    found = F.aggregate(between, start, step)["at"]
    return F.slice(found, 1, F.size(found) - 1)


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def normal_eol(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def restored_eol(text: Column, like: Column) -> Column:
    """CRLF ends again if the text that it came from had them."""
    return F.when(F.contains(like, F.lit("\r\n")), F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)


def excerpt(text: Column, whole: int = EXCERPT_WHOLE, head: int = EXCERPT_HEAD, tail: int = EXCERPT_TAIL) -> Column:
    """A text of up to `whole` characters, else its head and tail around a mark."""
    n = F.char_length(text)
    return F.when(n <= whole, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(EXCERPT_MARK), F.right(text, F.lit(tail))))


def telemetry_preview(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n < TELEMETRY_WHOLE, text).otherwise(F.concat(F.left(text, F.lit(TELEMETRY_SIDE)), F.lit(TELEMETRY_MARK), F.right(text, F.lit(TELEMETRY_SIDE))))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")


def suffix_cut(text: Column, most: int = RPC_CHARS) -> Column:
    """A text cut at `most` characters with the number of those dropped; no cut if most is 0 or less."""
    if most <= 0:
        return text
    n = F.char_length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("... [truncated "), (n - most).cast("string"), F.lit(" chars]")))


def ellipsis(text: Column, most: int, mark: str = "...", keep: int | None = None) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most if keep is None else keep)), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    """All lines trimmed, blank ones dropped, joined by one space."""
    parts = F.transform(lines_physical(text), trimmed)
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def tag_value(text: Column, tag: str) -> Column:
    """Trimmed content of the first <tag>, null if there is none or it is empty."""
    got = F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.when(got == "", None).otherwise(trimmed(got))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def generic_stripped(name: Column) -> Column:
    """A type's name up to the backtick before its arity."""
    return F.substring_index(name, "`", 1)


def type_name(name: Column, parameters: Column) -> Column:
    """A type's name with the names of its parameters, an array that may be empty, in angle brackets."""
    own = generic_stripped(name)
    return F.when(F.size(parameters) > 0, F.concat(own, F.lit("<"), F.array_join(parameters, ", "), F.lit(">"))).otherwise(own)


def nested_dotted(name: Column) -> Column:
    """Nested types are joined by dots."""
    return F.replace(name, F.lit("/"), F.lit("."))


def access_keyword(access: Column) -> Column:
    """The keyword of an accessibility, empty for those that aren't shown."""
    out = F.lit("")
    for name, keyword in reversed(ACCESS.items()):
        out = F.when(access == name, keyword).otherwise(out)
    return out


def modifiers(access: Column, static: Column) -> Column:
    """Keywords in front of a member, each with a blank after it."""
    keyword = access_keyword(access)
    return F.concat(F.when(keyword == "", "").otherwise(F.concat(keyword, F.lit(" "))), F.when(static, "static ").otherwise(""))


def signature(kind: Column, name: Column, returned: Column, type_name: Column, type_parameters: Column, parameters: Column, getter: Column, setter: Column) -> Column:
    """A member as it is declared: a field's type and name, a property's accessors, or a method's type parameters and parameters.

    kind is field, property, method or ctor, which has its type's name and returns nothing; parameters are an array of (type, name), a blank name is arg; slashes in types are dots.
    """
    own = F.concat(nested_dotted(returned), F.lit(" "), name)
    accessors = F.concat(F.lit(" { "), F.when(getter, "get; ").otherwise(""), F.when(setter, "set; ").otherwise(""), F.lit("}"))
    listed = F.array_join(F.transform(parameters, lambda p: F.concat(nested_dotted(p["type"]), F.lit(" "), F.when(trimmed(F.coalesce(p["name"], F.lit(""))) == "", "arg").otherwise(p["name"]))), ", ")
    types = F.when(F.size(type_parameters) > 0, F.concat(F.lit("<"), F.array_join(type_parameters, ", "), F.lit(">"))).otherwise("")
    called = F.concat(F.when(kind == "ctor", type_name).otherwise(own), types, F.lit("("), listed, F.lit(");"))
    return F.when(kind == "field", F.concat(own, F.lit(";"))).when(kind == "property", F.concat(own, accessors)).otherwise(called)


def public_or_protected(access: Column) -> Column:
    return access.isin(*ACCESS)


def generated_name(name: Column) -> Column:
    """Names that compilers make hold angle brackets."""
    return F.contains(name, F.lit("<")) | F.contains(name, F.lit(">"))


def without_backticks(text: Column) -> Column:
    """Backticks as apostrophes, for text within backticks."""
    return F.translate(text, "`", "'")


def megabytes(size: Column) -> Column:
    return size / (1024.0 * 1024.0)


#: What has a short escape in JSON, and ASCII that is written as its number.
JSON_SHORT = {"\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
JSON_NUMBERED = "\"&'+<>`\x7f"


def _json_char(c: Column) -> Column:
    """A character of a string in JSON: short escapes, and numbers of UTF-16 units for marks of markup and all beyond ASCII."""
    n = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.hex(x), 4, "0"))
    high = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
    out = F.when(n > 0xFFFF, high)
    for mark, short in JSON_SHORT.items():
        out = out.when(c == mark, short)
    return out.when((n < 0x20) | (n > 0x7F) | F.contains(F.lit(JSON_NUMBERED), c), unit(n)).otherwise(c)


def json_compact(text: Column) -> Column:
    """JSON without white space between its parts and with its strings as the writer escapes them; text that isn't JSON stays as it is."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*+"|[^"\s]+)'), 1)
    plain = r'^"[\x20!#-%(-*,-;=?-\[\]-_a-~]*+"$'  # most strings stay as they are
    told = lambda t: F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]
    again = lambda t: F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(told(t), ""), lambda c: c != ""), _json_char), ""), F.lit('"'))
    written = F.array_join(F.transform(parts, lambda t: F.when(F.startswith(t, F.lit('"')) & ~F.rlike(t, F.lit(plain)), again(t)).otherwise(t)), "")
    return F.when(F.try_parse_json(text).isNotNull(), written).otherwise(text)


def rpc_params(text: Column, most: int = RPC_CHARS) -> Column:
    """The parameters of a request as they are logged."""
    return F.coalesce(suffix_cut(json_compact(text), most), F.lit("(none)"))


def last_line(start: Column, count: Column) -> Column:
    """The last line of a range, null where it is too large a number."""
    return F.try_subtract(F.try_add(start.cast("int"), count.cast("int")), F.lit(1))


def line_cut(line: Column, most: int = SOURCE_LINE_CHARS) -> Column:
    """A line without its last white space, and an ellipsis for what goes beyond its limit."""
    return ellipsis(F.regexp_replace(line, r"\s+$", ""), most, "…")


def guarded(text: Column, most: int = DECOMPILED_LINES) -> Column:
    """A text, or null where it has more lines than are shown at once."""
    return F.when(F.size(lines(text)) <= most, text)
