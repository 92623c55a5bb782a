"""Decoding, signatures, headers and n-grams as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.schema import SIGNATURE_FIELDS

DECODE_PASSES = 3
NGRAM_SIZES = (3, 4, 5)
# Every character Python's str.strip treats as blank.
_BLANK = r"[\s\x1c-\x1f]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def percent_decode(c: Column, plus_is_space: bool = True) -> Column:
    """One decoding pass. A ``%`` that starts no escape is kept, so nothing turns null."""
    guarded = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(guarded)


def decode(c: Column | str, passes: int = DECODE_PASSES) -> Column:
    """Decode to a fixed point, at most ``passes`` times. A fixed point stays put under further
    passes, so the text needs no test between them."""
    out = _text(c)
    for _ in range(passes):
        out = percent_decode(out)
    return out


def decode_depth(c: Column | str, passes: int = DECODE_PASSES) -> Column:
    """How many passes changed the text."""
    before, depth = _text(c), F.lit(0)
    for _ in range(passes):
        after = percent_decode(before)
        depth = depth + (after != before).cast("int")
        before = after
    return depth


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def request_text(path: str = "url_path_raw", query: str = "url_query",
                 body: str = "request_body") -> Column:
    """``path query body`` separated by single blanks, nulls as empty text."""
    return F.concat_ws(" ", _text(path), _text(query), _text(body))


def split_target(target: Column) -> tuple[Column, Column]:
    """Path and query around the first ``?``; the query is ``""`` when there is none."""
    at = F.instr(target, "?")
    path = F.when(at > 0, F.substring(target, F.lit(1), at - 1)).otherwise(target)
    query = F.when(at > 0, F.substring(target, at + 1, F.length(target))).otherwise(F.lit(""))
    return path, query


def header_entries(headers: Column | str) -> Column:
    """Key/value entries of a JSON header object; null for anything unreadable."""
    return F.map_entries(F.from_json(_text(headers), "map<string,string>"))


def lookup(entries: Column, *names: str) -> Column:
    """Case-insensitive lookup in parsed entries: the first non-empty name wins, ``""`` if none
    is there. Of keys equal but for case the last one counts."""
    def value(name: str) -> Column:
        same = F.filter(entries, lambda e: F.lower(e["key"]) == name.lower())
        return F.try_element_at(same, F.lit(-1))["value"]

    *rest, last = names
    out = F.coalesce(value(last), F.lit(""))
    for name in reversed(rest):
        out = F.when(value(name) != "", value(name)).otherwise(out)
    return out


def header(headers: Column | str, *names: str) -> Column:
    return lookup(header_entries(headers), *names)


def with_detector_fields(df: DataFrame) -> DataFrame:
    """Add ``field_a`` (target and body), ``field_b`` (user agent and referer), both decoded,
    ``raw_target`` and ``encoding_depth``. Headers are parsed once and every decoding pass is a
    column of its own, so nothing is computed twice."""
    h = F.col("_h")
    out = df.withColumns({"raw_target": strip(request_text()), "_h": header_entries("headers")})
    out = out.withColumn("_b0", strip(F.concat_ws(
        " ", lookup(h, "user-agent"), lookup(h, "referer", "referrer")))).withColumn("_a0", F.col("raw_target"))
    for n in range(DECODE_PASSES):
        out = out.withColumns({f"_{f}{n + 1}": percent_decode(F.col(f"_{f}{n}")) for f in "ab"})
    changed = {f: sum((F.col(f"_{f}{n + 1}") != F.col(f"_{f}{n}")).cast("int") for n in range(DECODE_PASSES))
               for f in "ab"}
    out = out.withColumns({"field_a": F.col(f"_a{DECODE_PASSES}"), "field_b": F.col(f"_b{DECODE_PASSES}"),
                           "encoding_depth": F.greatest(changed["a"], changed["b"])})
    return out.drop("_h", *[f"_{f}{n}" for f in "ab" for n in range(DECODE_PASSES + 1)])


def signature(columns: Sequence[str] = SIGNATURE_FIELDS) -> Column:
    """The text that identifies a request. Narrower or wider variants pass other columns."""
    return F.concat_ws("|", *[_text(c) for c in columns])


def signature_key(columns: Sequence[str] = SIGNATURE_FIELDS) -> Column:
    """Fixed-width SHA-256 of the signature: what is shuffled instead of whole bodies."""
    return F.sha2(signature(columns), 256)


def headers_json(**columns: Column) -> Column:
    """Header object with the given keys; a null value leaves its key out."""
    return F.to_json(F.struct(*[c.alias(k.replace("_", "-")) for k, c in columns.items()]))


def headers_json_nonempty(wire_names: dict[str, str]) -> Column:
    """Header object of the non-empty columns only (``column -> header name``)."""
    pairs = [x for col, name in wire_names.items() for x in (F.lit(name), _text(col))]
    return F.to_json(F.map_filter(F.create_map(*pairs), lambda _, v: v != ""))


def site_key(path: Column | str = "url_path_raw") -> Column:
    """First path segment, lower case; ``(root)`` when there is none."""
    segment = F.lower(F.regexp_extract(_text(path), "^/([^/?]*)", 1))
    return F.when(segment == "", F.lit("(root)")).otherwise(segment)


def ngrams(c: Column | str, sizes: Sequence[int] = NGRAM_SIZES) -> Column:
    """All character n-grams, case kept. Runs of two or more blanks count as one blank. A lookahead that captures n characters
    matches at every place, so one pass of the text gives all of a size; places inside a surrogate pair are none."""
    one_blank = F.regexp_replace(_text(c), r"(?U)[\s\x1c-\x1f]{2,}", " ")
    return F.concat(*[F.regexp_extract_all(one_blank, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{%d}))" % n), F.lit(1)) for n in sizes])


def family_text() -> Column:
    """Text the family head reads: target and body decoded apart, joined by a blank."""
    target = F.concat_ws(" ", _text("url_path_raw"), _text("url_query"))
    return F.concat_ws(" ", decode(target), decode("request_body"))


def review_text(c: Column | str, limit: int = 400) -> Column:
    """Cut shown to a reviewer; analysis always uses the whole text."""
    return F.substring(_text(c), 1, limit)
