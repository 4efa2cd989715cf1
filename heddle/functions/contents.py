"""Columns for metadata that pages embed as JSON objects: values by dotted path out of VARIANT,
texts, counts, and what a content must keep to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import strip

MOST_TEXT_BYTES = 4096

# Schemes of locators, which are no metadata.
SCHEMES = (
    "blob", "data", "file", "ftp", "ftps", "geo", "git", "gs", "http", "https", "ipfs", "ipns", "irc", "ircs", "javascript", "magnet", "mailto", "news", "nntp",
    "s3", "sip", "sips", "sms", "ssh", "tel", "urn", "webcal", "ws", "wss", "xmpp",
)

# Material types by file extension.
MATERIALS = {
    "video": ("mp4", "mkv", "mov", "webm", "m4v", "avi"),
    "audio": ("mp3", "m4a", "flac", "wav", "ogg", "aac"),
    "document": ("pdf", "epub", "mobi", "fb2", "doc", "docx", "txt", "rtf"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso"),
    "image": ("jpg", "jpeg", "png", "gif", "webp", "svg"),
    "torrent": ("torrent",),
}

CONTENT = (
    "struct<name:string,kind:string,size_bytes:bigint,file_count:bigint,folder_count:bigint,"
    "items:array<struct<name:string,kind:string,size_bytes:bigint>>,material_types:array<string>>"
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def material_types(names: Column) -> Column:
    """Sorted distinct material types of file names."""
    ends = F.transform(names, lambda n: F.lower(F.regexp_extract(strip(n), r"\.([^./\\]+)$", 1)))
    one = F.array(*[F.when(F.arrays_overlap(ends, F.array(*[F.lit(x) for x in xs])), F.lit(t)) for t, xs in MATERIALS.items()])
    return F.array_sort(F.array_compact(one))


_EDGE = r"(?U)^\s|\s$"


def is_locator(lower: Column) -> Column:
    """A lower-case text that holds ``://`` or begins with a scheme."""
    return lower.rlike("://|^(?:" + "|".join(SCHEMES) + "):")


def is_metadata(text: Column) -> Column:
    """What a stored text must be: trimmed, of bounded size, without control characters, angle
    brackets or locators.  Null is no text and fits."""
    fits = (F.octet_length(text) <= MOST_TEXT_BYTES) & ~text.rlike(_EDGE + r"|[\p{Cc}<>]") & ~is_locator(F.lower(text))
    return F.when(text.isNull(), True).otherwise(fits)


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def reach(root: Column, path: Column) -> Column:
    """struct(v, bad): the value at a dotted path; null where a member is not there, bad where the
    path goes on below something that is no object.  An empty path reaches nothing."""

    def step(state: Column, name: Column) -> Column:
        return bound(_members(state["v"]), lambda m: F.struct(F.element_at(m, name).alias("v"), (state["bad"] | (state["v"].isNotNull() & m.isNull())).alias("bad")))

    nothing = F.struct(F.lit(None).cast("variant").alias("v"), F.lit(False).alias("bad"))
    return F.when(F.coalesce(path, F.lit("")) == "", nothing).otherwise(F.aggregate(F.split(path, r"\."), F.struct(root.alias("v"), F.lit(False).alias("bad")), step))


def text_at(root: Column, path: Column) -> Column:
    """struct(v, bad): a text whose control characters are blanks.  What is no text, hides a locator
    behind control characters or is too long is bad."""

    # most texts have no control characters and no blanks at their edges: those are only looked at
    def cleaned(r: Column) -> Column:
        raw = r["v"].cast("string")
        return bound(F.struct(raw.alias("raw"), raw.rlike(r"\p{Cc}").alias("odd"), (F.schema_of_variant(r["v"]) != "STRING").alias("other"), r["bad"].alias("bad")), trimmed)

    def trimmed(s: Column) -> Column:
        flat = F.when(s["odd"], F.regexp_replace(s["raw"], r"\p{Cc}", " ")).otherwise(s["raw"])
        hidden = F.when(s["odd"], is_locator(F.lower(strip(F.regexp_replace(s["raw"], r"\p{Cc}", ""))))).otherwise(F.lit(False))
        judge = lambda out: F.struct(F.when(out != "", out).alias("v"), (s["bad"] | s["other"] | hidden | (F.octet_length(out) > MOST_TEXT_BYTES)).alias("bad"))
        return bound(bound(flat, lambda f: F.when(f.rlike(_EDGE), strip(f)).otherwise(f)), judge)

    nothing = lambda r: F.struct(F.lit(None).cast("string").alias("v"), r["bad"].alias("bad"))
    return bound(reach(root, path), lambda r: F.when(r["v"].isNull(), nothing(r)).otherwise(cleaned(r)))


def count_at(root: Column, path: Column) -> Column:
    """struct(v, bad): a whole number from 0 up to the largest long."""

    def whole(r: Column) -> Column:
        n = F.try_variant_get(r["v"], "$", "bigint")
        wrong = (F.schema_of_variant(r["v"]) != "BIGINT") | (n < 0)
        nothing = F.struct(F.lit(None).cast("bigint").alias("v"), r["bad"].alias("bad"))
        return F.when(r["v"].isNull(), nothing).otherwise(F.struct(n.alias("v"), (r["bad"] | wrong).alias("bad")))

    return bound(reach(root, path), whole)


def content_at(root: Column, fields: Column, max_items: int) -> Column:
    """struct(content, bad) of a decoded object; ``fields`` maps the names of a content's fields to their
    paths.  Items beyond ``max_items`` are not looked at; any other value of a wrong type is bad."""

    def item(v: Column) -> Column:
        name, kind, size = text_at(v, fields["item_name"]), text_at(v, fields["item_kind"]), count_at(v, fields["item_size_bytes"])
        one = F.struct(name.alias("name"), kind.alias("kind"), size.alias("size"), _members(v).isNull().alias("other"))
        return bound(one, lambda x: F.struct(F.struct(x["name"]["v"].alias("name"), x["kind"]["v"].alias("kind"), x["size"]["v"].alias("size_bytes")).alias("v"), (x["other"] | x["name"]["bad"] | x["kind"]["bad"] | x["size"]["bad"]).alias("bad")))

    def listed(r: Column) -> Column:
        values = F.try_variant_get(r["v"], "$", "array<variant>")
        return F.struct(F.transform(F.slice(values, 1, max_items), item).alias("v"), (r["bad"] | (r["v"].isNotNull() & values.isNull())).alias("bad"))

    whole = F.struct(
        text_at(root, fields["name"]).alias("name"), text_at(root, fields["kind"]).alias("kind"), count_at(root, fields["size_bytes"]).alias("size"), count_at(root, fields["file_count"]).alias("files"),
        count_at(root, fields["folder_count"]).alias("folders"), bound(reach(root, fields["items"]), listed).alias("items"),
    )

    def put(x: Column) -> Column:
        items = F.transform(x["items"]["v"], lambda i: i["v"])
        names = F.concat(F.array(x["name"]["v"]), F.coalesce(F.transform(items, lambda i: i["name"]), F.array().cast("array<string>")))
        content = F.struct(
            x["name"]["v"].alias("name"), x["kind"]["v"].alias("kind"), x["size"]["v"].alias("size_bytes"), x["files"]["v"].alias("file_count"), x["folders"]["v"].alias("folder_count"),
            F.when(F.size(items) > 0, items).alias("items"), material_types(names).alias("material_types"),
        )
        bad = x["name"]["bad"] | x["kind"]["bad"] | x["size"]["bad"] | x["files"]["bad"] | x["folders"]["bad"] | x["items"]["bad"] | F.exists(F.coalesce(x["items"]["v"], F.array()), lambda i: i["bad"])
        return F.struct(F.when(~bad, content).alias("content"), bad.alias("bad"))

    return bound(whole, put)


def content_rules(c: Column, max_items: int = 1000) -> dict[str, Column]:
    """What a content must keep to, by the name of the rule; none of them is null."""
    count = lambda n: F.coalesce(c[n] >= 0, F.lit(True))
    every = lambda ok: F.coalesce(F.forall(c["items"], ok), F.lit(True))
    some = F.lit(False)
    for n in ("name", "kind"):
        some = some | (F.coalesce(c[n], F.lit("")) != "")
    for n in ("size_bytes", "file_count", "folder_count"):
        some = some | (F.coalesce(c[n], F.lit(0)) != 0)
    types = c["material_types"]
    return {
        "text": F.coalesce(is_metadata(c["name"]) & is_metadata(c["kind"]), F.lit(False)),
        "size": count("size_bytes"),
        "file_count": count("file_count"),
        "folder_count": count("folder_count"),
        "items": F.coalesce(F.size(c["items"]) <= max_items, F.lit(True)),
        "item_text": every(lambda i: is_metadata(i["name"]) & is_metadata(i["kind"])),
        "item_size": every(lambda i: F.coalesce(i["size_bytes"] >= 0, F.lit(True))),
        "material_types": F.coalesce((types == F.array_sort(F.array_distinct(types))) & F.forall(types, lambda t: F.coalesce(t.isin(*MATERIALS), F.lit(False))), F.lit(True)),
        "empty": some | F.coalesce(F.size(c["items"]) > 0, F.lit(False)),
    }
