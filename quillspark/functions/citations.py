"""References, citations, evidence kinds and closed vocabularies as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import citation_labels

#: What an evidence kind is called in a citation, and its role in a result.
KIND_LABELS = {"text": "original_text", "verse": "verse", "footnote": "footnote", "ocr": "ocr_text", "image": "image_artifact"}
KIND_ROLES = {"text": "original_text", "verse": "original_text", "footnote": "original_text", "ocr": "ocr_text", "image": "image_artifact"}
#: The types that extracted entities and relationships may have.
ENTITY_TYPES = ("feature", "component", "concept", "file", "function", "issue", "other")
RELATIONSHIP_TYPES = ("depends_on", "implements", "mentions", "conflicts_with", "supports", "other")


def _mapped(kind: Column, names: dict[str, str], derived_from: Column) -> Column:
    out = F.when((kind == "generated") & derived_from.isNotNull(), "image_caption_generated").when(kind == "generated", "generated")
    for k, v in names.items():
        out = out.when(kind == k, v)
    return out


def citation_kind(kind: Column, derived_from: Column) -> Column:
    """The name of an evidence kind in a citation; generated evidence with an origin is an image's caption."""
    return _mapped(kind, KIND_LABELS, derived_from)


def evidence_role(origin: Column, kind: Column, derived_from: Column) -> Column:
    """The role of evidence in a result: graph reports first, else by kind; verses and footnotes are original text."""
    return F.when(origin == "graph_report", "graph_report").otherwise(_mapped(kind, KIND_ROLES, derived_from))


def normalised_reference(values: Column) -> Column:
    """A reference's component values, lower-cased, without spaces, joined by colons."""
    return F.array_join(F.transform(values, lambda v: F.replace(F.lower(v), F.lit(" "), F.lit(""))), ":")


def rendered_reference(values: Column) -> Column:
    """'Book chapter:verse' of three or more values, fewer joined by spaces."""
    long = F.concat(values[0], F.lit(" "), values[1], F.lit(":"), F.array_join(F.slice(values, 3, F.greatest(F.size(values) - 2, F.lit(1))), ":"))
    return F.when(F.size(values) >= 3, long).otherwise(F.array_join(values, " "))


def prepared_query(query: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query) if instruction else query


def prepared_document(text: Column, heading: Column, instruction: str) -> Column:
    head = F.when(heading != "", F.concat(heading, F.lit(": "))).otherwise("")
    return F.concat(F.lit(f"{instruction}\n" if instruction else ""), head, text)


def schema_value(value: Column) -> Column:
    """Trimmed, lower-cased, spaces and hyphens as underscores."""
    return F.translate(F.lower(F.trim(value)), " -", "__")


def closed_type(value: Column, types: tuple[str, ...]) -> Column:
    """The value if it is one of the types, else null."""
    v = schema_value(value)
    return F.when(v.isin(*types), v)


def cited_only(answer: Column, evidence: Column) -> Column:
    """Of labelled evidence (structs with `label`, in order) what the answer cites, each label once, first row first."""
    labels = citation_labels(answer)
    kept = F.filter(evidence, lambda e: F.array_contains(labels, e["label"]))
    return F.filter(kept, lambda e, i: F.array_position(kept["label"], e["label"]) == i + 1)


def references_block(answer: Column, citations: Column) -> Column:
    """The answer with its citations (label, kind, locator, derived_from) listed under it."""
    line = lambda c: F.concat(F.lit("["), c["label"], F.lit("] "), citation_kind(c["kind"], c["derived_from"]), F.lit(": "), c["locator"], F.coalesce(F.concat(F.lit("; derived from "), c["derived_from"]), F.lit("")), F.lit("\n"))
    return F.concat(answer, F.lit("\n\nReferences:\n"), F.array_join(F.transform(citations, line), ""))


def report_summary(title: Column, claims: Column, most: int) -> Column:
    """Title and claims as sentences, claim after claim until `most` characters are reached, cut there."""

    def add(s: Column, claim: Column) -> Column:
        longer = F.concat(s, F.when(F.endswith(s, F.lit(" ")), "").otherwise(" "), claim)
        longer = F.concat(longer, F.when(F.endswith(longer, F.lit(".")), "").otherwise("."))
        return F.when((F.char_length(s) >= most) & (s != F.concat(title, F.lit(". "))), s).otherwise(longer)

    return F.substring(F.trim(F.aggregate(claims, F.concat(title, F.lit(". ")), add)), 1, most)
