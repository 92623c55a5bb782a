"""Static payload rewrites used to measure how detection holds up. Payloads are scored, never sent.

Where a rewrite makes a random choice it is drawn from a digest of the payload and the position,
so it needs no sequential generator and repeats on every run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Alternatives and the families each rewrite applies to.
BLANKS = ["\t", "\n", "\x0b", "\x0c", "%09", "+", "/**/"]
TAUTOLOGIES = ["2>1", "'a'='a'", "3-1=2", "1 like 1"]
TERMINATORS = ["%00", "\x00", "-- -", "#", "%23"]
ENTITY_CHARACTERS = "<>\"'()=;/ "
FAMILIES = ["sqli", "xss", "cmd_injection", "ssti", "path_traversal"]
APPLIES_TO = {
    "case": FAMILIES,
    "inline_comment": ["sqli", "cmd_injection"],
    "versioned_comment": ["sqli"],
    "whitespace_sub": ["sqli", "cmd_injection", "ssti"],
    "url_encode": FAMILIES,
    "double_url_encode": FAMILIES,
    "html_entity": ["xss", "sqli"],
    "equivalent_syntax": ["sqli"],
    "keyword_char": ["sqli"],
    "xss_alt": ["xss"],
    "null_terminator": FAMILIES,
}
_MARK = "\ue000"


def draw(seed: Column, salt: Column, n: int) -> Column:
    """Integer in [0, n) from the digest of seed and salt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, salt)), 1, 8), 16, 10).cast("bigint") % n


def _choice(options: Sequence[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))


def random_case(s: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(
        draw(seed, i.cast("string"), 2) == 0, F.upper(c)).otherwise(F.lower(c))), "")


def inline_comment(s: Column, seed: Column) -> Column:
    """Comments for blanks, and inside the first three runs of four or more letters."""
    out = F.replace(s, F.lit(" "), F.lit("/**/"))
    for _ in range(3):
        out = F.regexp_replace(out, f"(?s)^((?>.*{_MARK}|))(.*?)([A-Za-z]{{2}})([A-Za-z]{{2,}})",
                               f"$1$2$3/**/$4{_MARK}")
    return F.replace(out, F.lit(_MARK), F.lit(""))


def versioned_comment(s: Column, seed: Column) -> Column:
    return F.regexp_replace(s, r"(?i)\b(union|select|or|and)\b", "/*!50000$1*/")


def whitespace_sub(s: Column, seed: Column) -> Column:
    pieces = F.split(s, " ", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        i < F.size(pieces) - 1, F.concat(p, _choice(BLANKS, draw(seed, i.cast("string"), len(BLANKS)))))
        .otherwise(p)), "")


def url_encode(s: Column, seed: Column | None = None) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def double_url_encode(s: Column, seed: Column | None = None) -> Column:
    return url_encode(url_encode(s))


def html_entity(s: Column, seed: Column | None = None) -> Column:
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(
        (c != "") & F.lit(ENTITY_CHARACTERS).contains(c),
        F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")


def equivalent_syntax(s: Column, seed: Column) -> Column:
    out = F.regexp_replace(s, F.lit(r"(?i)1\s*=\s*1"),
                           _choice(TAUTOLOGIES, draw(seed, F.lit("tautology"), len(TAUTOLOGIES))))
    out = F.regexp_replace(out, "'1'='1'", "'a'='a'")
    return F.when(draw(seed, F.lit("like"), 10) < 3, F.regexp_replace(out, r"=\s*", " LIKE ")).otherwise(out)


def keyword_char(s: Column, seed: Column | None = None) -> Column:
    """Quoted literals of up to 20 characters as character codes."""
    quoted = "'([^']{1,20})'"
    plain = F.split(s, quoted, -1)
    literals = F.regexp_extract_all(s, F.lit(quoted), F.lit(1))
    codes = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("string")), ",")
    return F.array_join(F.zip_with(plain, literals, lambda p, t: F.when(t.isNull(), p).otherwise(
        F.concat(p, F.lit("CHAR("), codes(t), F.lit(")")))), "")


def xss_alt(s: Column, seed: Column) -> Column:
    out = F.regexp_replace(s, F.lit("(?i)<script"), F.concat(F.lit("<"), random_case(F.lit("script"), seed)))
    out = F.replace(out, F.lit("javascript:"), F.lit("java\tscript:"))
    return F.regexp_replace(out, "(?i)onerror", "OnErRoR")


def null_terminator(s: Column, seed: Column) -> Column:
    return F.concat(s, _choice(TERMINATORS, draw(seed, F.lit("end"), len(TERMINATORS))))


REWRITES: dict[str, Callable[[Column, Column], Column]] = {
    "case": random_case, "inline_comment": inline_comment, "versioned_comment": versioned_comment,
    "whitespace_sub": whitespace_sub, "url_encode": url_encode, "double_url_encode": double_url_encode,
    "html_entity": html_entity, "equivalent_syntax": equivalent_syntax, "keyword_char": keyword_char,
    "xss_alt": xss_alt, "null_terminator": null_terminator,
}


def mutate(payloads: DataFrame, payload: str = "payload", family: str = "attack_family") -> DataFrame:
    """One row per payload and applicable rewrite, the original included: ``mutation, mutated``.
    The table of rewrites is an array on the row itself, so nothing is joined."""
    seeded = payloads.withColumn("_seed", F.md5(F.col(payload)))
    s, seed = F.col(payload), F.col("_seed")
    variants = [F.struct(F.lit("original").alias("mutation"), s.alias("mutated"))]
    for name, rewrite in REWRITES.items():
        variants.append(F.when(F.col(family).isin(APPLIES_TO[name]), F.struct(
            F.lit(name).alias("mutation"), rewrite(s, seed).alias("mutated"))))
    return (seeded.withColumn("_v", F.explode(F.array_compact(F.array(*variants))))
            .select(*payloads.columns, "_v.mutation", "_v.mutated"))
