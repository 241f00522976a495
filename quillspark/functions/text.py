"""Text functions as Spark columns: tokens, keys, slugs, labels, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a run of ASCII letters and digits that cost a quarter token each; later ones cost one.
CHEAP_RUN = 24
#: Most characters of a document that a reranker reads.
RERANK_CHARS = 8000


def token_quarters(text: Column) -> Column:
    """Quarter tokens of a text: one for each of the first CHEAP_RUN characters of an ASCII alphanumeric run, else four."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    cheap = F.aggregate(runs, F.lit(0), lambda s, x: s + F.least(F.length(x), F.lit(CHEAP_RUN)))
    return (4 * F.char_length(text) - 3 * cheap).cast("long")


def token_estimate(text: Column) -> Column:
    """Tokens of a text: its quarter tokens over four, rounded up."""
    return F.ceil(token_quarters(text) / 4).cast("long")


def spaced_token_estimate(parts: Column) -> Column:
    """The same for an array of parts joined by single spaces, empty ones left out."""
    return token_estimate(F.array_join(F.filter(parts, lambda x: x != ""), " "))


def terms(text: Column) -> Column:
    """Lower-case letter and digit runs, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def match_expression(query: Column) -> Column:
    """A query's terms, quoted and joined by OR."""
    return F.array_join(F.transform(F.filter(F.split(query, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def support_score(query: Column, text: Column) -> Column:
    """Share of the query's terms (repeats count) that the text holds; 0 for a query without terms."""
    # a struct in an array: terms are cut once a row, not once for each term of the query
    both = F.array(F.struct(terms(query).alias("q"), F.array_distinct(terms(text)).alias("t")))
    share = F.transform(both, lambda x: F.size(F.filter(x["q"], lambda w: F.array_contains(x["t"], w))) / F.nullif(F.size(x["q"]), F.lit(0)))
    return F.coalesce(share[0], F.lit(0.0))


def token_set(text: Column) -> Column:
    """Distinct terms; ASCII ones of one or two characters are left out."""
    return F.array_distinct(F.filter(terms(text), lambda x: ~((F.length(x) <= 2) & x.rlike("^[\\x00-\\x7F]*$"))))


def normalize_key(label: Column) -> Column:
    """Lower-case letters and digits, any other run one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))


def lookup_key(label: Column) -> Column:
    """normalize_key, or `raw:` and 16 hex digits of a digest where that is empty."""
    key = normalize_key(label)
    return F.when(key != "", key).otherwise(F.concat(F.lit("raw:"), F.substring(F.sha2(label, 256), 1, 16)))


def heading_slug(title: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "section").otherwise(slug)


def citation_labels(answer: Column) -> Column:
    """Sorted distinct labels E<number> inside square brackets."""
    inside = F.regexp_extract_all(answer, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike("^E[0-9]+$"))))


def citations_resolved(answer: Column, labels: Column) -> Column:
    """Whether the answer cites something, and just the given labels."""
    cited = citation_labels(answer)
    return (F.size(cited) > 0) & (cited == F.array_sort(F.array_distinct(labels)))


def source_span(raw: Column) -> Column:
    """`chunk:lo-hi` as a struct, null if malformed."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(raw, pattern, i)
    return F.when(raw.rlike(pattern), F.struct(part(1).alias("chunk_id"), part(2).cast("long").alias("lo"), part(3).cast("long").alias("hi")))


def search_text(context: Column, text: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", text).otherwise(F.concat_ws(" ", context, text))


def rerank_text(context: Column, text: Column) -> Column:
    return F.substring(search_text(context, text), 1, RERANK_CHARS)


def embedding_input(heading: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(heading, F.lit("")), text)


def embedding_budget(context: Column) -> Column:
    """Three quarters of a model's context, one at least."""
    return F.greatest(F.floor(context * 3 / 4), F.lit(1))


def logical_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".")), "/")


def _matches(regex: str):
    return lambda segment: segment.rlike(regex)


def ignored(path: Column, patterns: list[str], is_dir: Column | None = None) -> Column:
    """Whether a glob (* and ?) matches: a trailing / means folders only, a pattern without / any segment of the path."""
    out = F.lit(False)
    for pattern in patterns:
        dirs, body = pattern.endswith("/"), pattern.rstrip("/")
        regex = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in body) + "$"
        hit = path.rlike(regex) if "/" in body else F.exists(F.split(path, "/"), _matches(regex))
        out = out | (hit & (is_dir if is_dir is not None else F.lit(False)) if dirs else hit)
    return out


def first_profile(text: Column, profiles: dict[str, Column], most: int = 200) -> Column:
    """The name of the first profile that reads the text with certainty; null for none, and for texts of more characters."""
    out = None
    for name, sure in profiles.items():
        out = F.when(sure, name) if out is None else out.when(sure, name)
    return F.when(F.char_length(text) <= most, out)


def metadata_string(metadata: Column, key: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(metadata, f"$.{key}")), F.lit(""))


def line_at(text: Column, byte: Column) -> Column:
    """Line number (from 1) at a byte offset of the text's UTF-8."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte)
    return F.size(F.split(F.decode(head, "UTF-8"), "\n"))


def stable_id(kind: str, *parts: Column) -> Column:
    """Content-addressed id: kind and a digest of length-prefixed parts."""
    framed = [F.concat(F.octet_length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.concat(F.lit(f"{kind}:v1:"), F.sha2(F.concat(*framed), 256))


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter: a letter whose capital is one letter takes it (ß takes ẞ), others stay, so lower case
    leads back. Spark's `upper` makes SS of ß."""
    letters = F.split(F.translate(text, "ß", "ẞ"), "")
    return F.array_join(F.transform(letters, lambda c: F.when(F.char_length(F.upper(c)) == F.char_length(c), F.upper(c)).otherwise(c)), "")
