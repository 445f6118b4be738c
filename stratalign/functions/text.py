"""Text, date, unit and hash functions as Column expressions.

All run inside the JVM. White space means Unicode white space where the name says nothing else. A null counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalign.functions.printf import g12

# Factors to molar of the accepted units (case counts).
MOLAR = {"M": 1.0, "mM": 1e-3, "uM": 1e-6, "µM": 1e-6, "μM": 1e-6, "nM": 1e-9, "pM": 1e-12, "fM": 1e-15}

SEPARATOR = "\x1f"
WEAK_PREFIXES = {"document": ("DOC_TITLE:", "DOC_PAGE:", "DOC_VOLPAGE:"), "assay": ("ASSAY_SEM:",)}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_text(c: Column) -> Column:
    """Trimmed, inner white space collapsed, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def norm_identity(c: Column, dtype: str = "string") -> Column:
    """As norm_text; an integral double becomes integer text first."""
    if dtype in ("double", "float"):
        whole = F.floor(c) == c
        c = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return norm_text(c)


def norm_doi(c: Column) -> Column:
    """A DOI without resolver or scheme; '' if it can't be one."""
    s = F.regexp_replace(norm_text(c), r"^HTTPS?://(DX\.)?DOI\.ORG/", "")
    s = F.trim(F.regexp_replace(s, r"^DOI\s*:\s*", ""))
    return F.when(s.rlike(r"^10\.[^/\s]+/\S+$"), s).otherwise("")


def norm_pmid(c: Column) -> Column:
    """An unsigned integer without leading zeros; '' if it is none."""
    s = F.regexp_replace(norm_text(c), r"^(\d+)\.0+$", "$1")
    return F.when(s.rlike(r"^\d+$"), F.regexp_replace(s, r"^0+(?=\d)", "")).otherwise("")


def norm_integer_like(c: Column) -> Column:
    """``12.0`` and ``+012`` as ``12``; other text as it is."""
    s = norm_text(c)
    pointed = s.rlike(r"^[+-]?\d+\.0+$")
    plain = s.rlike(r"^[+-]?\d+$")
    digits = F.regexp_replace(F.regexp_replace(s, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(pointed, F.regexp_extract(s, r"^([+-]?\d+)", 1)).when(plain, F.when(digits == "-0", "0").otherwise(digits)).otherwise(s)


def norm_bib(c: Column, field: str) -> Column:
    """A bibliographic field: numeric ones integer-like, others text."""
    numeric = field.removeprefix("document_") in ("year", "volume", "issue", "first_page")
    return norm_integer_like(c) if numeric else norm_text(c)


def norm_sequence(c: Column) -> Column:
    return F.upper(F.regexp_replace(text(c), "[^A-Za-z]", ""))


def sha_key(prefix: str, *parts: Column) -> Column:
    """prefix and the SHA-256 of the parts, joined by U+001F."""
    return F.concat(F.lit(prefix), F.sha2(F.array_join(F.array(*parts), SEPARATOR), 256))


def set_key(prefix: str, items: Column) -> Column:
    """The content address of a set of strings: sorted, then as sha_key."""
    return F.concat(F.lit(prefix), F.sha2(F.array_join(sorted_set(items), SEPARATOR), 256))


def pol_base(c: Column) -> Column:
    return F.regexp_replace(c, r"_POL_\d+$", "")


def parse_source_alias(alias: Column) -> Column:
    """struct(source, id) of ``SRCASSAY:source:id``; null if it is none."""
    body = F.regexp_extract(alias, r"^SRCASSAY:(.*)$", 1)
    ok = alias.startswith("SRCASSAY:") & body.contains(":")
    return F.when(ok, F.struct(F.substring_index(body, ":", 1).alias("source"), F.regexp_extract(body, r"^[^:]*:(.*)$", 1).alias("id")))


def sorted_set(items: Column) -> Column:
    """Sorted different non-empty items (A1)."""
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def split_pipe(c: Column) -> Column:
    return F.filter(F.split(text(c), "[|]"), lambda x: x != "")


def join_pipe(items: Column) -> Column:
    return F.array_join(sorted_set(items), "|")


def pipe_count(c: Column) -> Column:
    return F.length(text(c)) - F.length(F.replace(text(c), F.lit("|"), F.lit(""))) + 1


def has_token(c: Column, token: str) -> Column:
    """``token`` is one of the piped items: whole items, never substrings (P10)."""
    return F.array_contains(split_pipe(c), token)


def belongs_to_family(alias: Column, family: str) -> Column:
    """The left of ``=>`` is the family's alias or one of its ``_POL_`` parts."""
    left = F.substring_index(alias, "=>", 1)
    return (left == f"SRCASSAY:{family}") | left.startswith(f"SRCASSAY:{family}_POL_")


def norm_release_label(c: Column, prefix: str = "CHEMBL") -> Column:
    """``CHEMBL_2``, ``2`` -> ``CHEMBL02``; ``22.1`` -> ``CHEMBL22.1``; others '' (S14)."""
    s = F.upper(F.trim(text(c)))
    pattern = rf"^(?:{prefix})?[_\s-]*(\d+)(?:[._](\d+))?$"
    major = F.regexp_replace(F.regexp_extract(s, pattern, 1), r"^0+(?=\d)", "")
    minor = F.regexp_extract(s, pattern, 2)
    padded = F.when(F.length(major) < 2, F.lpad(major, 2, "0")).otherwise(major)
    return F.when(~s.rlike(pattern), "").otherwise(F.concat(F.lit(prefix), padded, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise("")))


def release_token(c: Column) -> Column:
    """``22.1`` -> ``22_1``; ``1`` -> ``01`` (IO2)."""
    major, minor = F.substring_index(c, ".", 1), F.when(c.contains("."), F.concat(F.lit("_"), F.substring_index(c, ".", -1))).otherwise("")
    return F.concat(F.when(F.length(major) < 2, F.lpad(major, 2, "0")).otherwise(major), minor)


def archive_urls(release: Column, root: str) -> Column:
    """The two places below ``root`` at which a release's archive may be, in the order to try them (IO2)."""
    name = F.concat(F.lit("chembl_"), release_token(release))
    file = F.concat(name, F.lit("_sqlite.tar.gz"))
    return F.array(F.concat_ws("/", F.lit(root), name, file), F.concat_ws("/", F.lit(root), name, F.lit("archived"), file))


def norm_url(c: Column) -> Column:
    """A URL without scheme, www. or m., query, fragment and closing slashes, in lower case."""
    s = F.regexp_replace(F.lower(c), r"^https?://(www\.|m\.)?", "")
    return F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), "/+$", "")


def numeric_like(c: Column) -> Column:
    return F.trim(text(c)).rlike(r"^[+-]?\d+(\.0+)?$")


def iso_date(c: Column) -> Column:
    """The date that the text begins with, or null."""
    return F.try_to_date(F.regexp_extract(F.trim(text(c)), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def is_exact_date(c: Column) -> Column:
    return text(c).rlike(r"^\d{4}-\d{2}-\d{2}$")


def publication_date(year: Column) -> Column:
    """1 July of a plausible year, else null."""
    y = year.cast("string").try_cast("double").try_cast("int")
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(7), F.lit(1)))


def to_molar(value: Column, unit: Column) -> Column:
    """Molar value of a finite positive value in a known unit, else null (M1)."""
    v = value.try_cast("double")
    factors = F.create_map(*[F.lit(x) for kv in MOLAR.items() for x in kv])
    ok = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    return F.when(ok, v * factors[F.trim(text(unit))])


def pactivity(molar: Column) -> Column:
    return F.when(molar > 0, -F.log10(molar))


def canon_float(x: Column) -> Column:
    """``%.12g`` (M3), '' for null and not-a-number."""
    v = x.cast("double")
    return F.when(v.isNull() | F.isnan(v), "").otherwise(g12(v))


def safe_ratio(k: Column, n: Column, otherwise: float | None = 0.0) -> Column:
    ratio = F.try_divide(k.cast("double"), n.cast("double"))
    return ratio if otherwise is None else F.coalesce(ratio, F.lit(otherwise))


def percent(k: Column, n: Column, places: int = 2) -> Column:
    """Half-even rounding."""
    return F.bround(100.0 * safe_ratio(k, n), places)


def truthy(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def duplicate_flag(c: Column) -> Column:
    """1 as a number, or a word for yes."""
    s = F.upper(F.trim(text(c)))
    return F.coalesce(s.try_cast("double") == 1, F.lit(False)) | s.isin("1", "1.0", "Y", "YES", "TRUE", "T")


def validity_ok(c: Column) -> Column:
    return F.upper(F.trim(text(c))).isin("", "MANUALLY VALIDATED")


def relation_ok(c: Column) -> Column:
    return F.trim(text(c)).isin("=", "<", ">")


def plausible_year(year: Column, low: int = 1800, high: int = 2026) -> Column:
    return year.cast("string").try_cast("double").between(low, high)


def is_weak(alias: Column, kind: str) -> Column:
    """The alias bridges on description alone, not on an authority's id."""
    if kind not in WEAK_PREFIXES:
        raise ValueError(f"unknown identity kind: {kind}")
    out = F.lit(False)
    for prefix in WEAK_PREFIXES[kind]:
        out = out | alias.startswith(prefix)
    return out


def count_prefix(items: Column, *prefixes: str) -> Column:
    def any_of(x: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | x.startswith(p)
        return out

    return F.size(F.filter(items, any_of))


def external_conflict(items: Column, kind: str) -> Column:
    """More than one id of one authority: two DOIs or PMIDs, two source assays."""
    if kind == "document":
        return (count_prefix(items, "DOI:") > 1) | (count_prefix(items, "PMID:") > 1)
    if kind == "assay":
        return count_prefix(items, "SRCASSAY:") > 1
    raise ValueError(f"unknown identity kind: {kind}")


def activity_keys(assay: str, structure: str, endpoint: str, relation: str, molar: Column, target: str) -> dict[str, Column]:
    """activity_key, pair_key and cross_endpoint_pair_key (H1). A null field is the word None."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    parts = [word(assay), word(structure), word(endpoint), word(relation), molar, word(target)]
    cross = F.concat(word(structure), F.lit("|"), word(target))
    return {
        "activity_key": F.sha2(F.array_join(F.array(*parts), "|"), 256),
        "pair_key": F.concat(cross, F.lit("|"), word(endpoint)),
        "cross_endpoint_pair_key": cross,
    }
