"""Column expressions: folds, shapes of names and headings, text measures, ids. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of sections that hold no content, and of those that are no evidence.
NO_CONTENT = (
    "index", "general index", "subject index", "name index", "author index", "index of names", "bibliography", "select bibliography", "references", "reference list",
    "works cited", "cited works", "table of contents", "contents", "copyright", "list of figures", "list of tables", "list of illustrations", "list of maps", "list of abbreviations",
)
NO_EVIDENCE = (
    "notes", "endnotes", "end notes", "footnotes", "notes and references", "preface", "foreword", "acknowledgements", "acknowledgments", "dedication", "epigraph",
    "about the author", "about the authors", "notes on contributors", "glossary", "abbreviations", "chronology", "front matter", "back matter", "title page", "half title", "contributors",
)
AFTER_ORDINAL = (
    "bibliography", "references", "articles and periodicals", "books", "books and articles", "primary sources", "secondary sources", "unpublished sources", "archival sources",
    "newspapers and periodicals",
)
ENDINGS = ("bibliography", "secondary sources")
# Patterns of surfaces that are no names.
LOCATOR = r"(?i)^(fig\.?|figure|table|map|chart|graph|plate|box|diagram|appendix)\b"
NUMERAL = r"(?i)^[0-9]+(st|nd|rd|th)?( century)?$"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
APPARATUS = rf"(?i)^(chapter|chap\.|ch\.|footnote|endnote|fig\.?|figure|table|map|chart|graph|plate|box|diagram|appendix)\s+([0-9]|({NUMBER_WORDS})\b)"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DATE = rf"(?i)^([0-9]{{4}}s?\s*[-‐-―/]\s*[0-9]{{2,4}}s?|[0-9]{{4}}s|[0-9]{{1,2}}\s+({MONTHS})\s+[0-9]{{4}}|({MONTHS})\s+[0-9]{{1,2}},\s*[0-9]{{4}}|({MONTHS})\s+[0-9]{{4}})$"
REFERENCE = r"(?i)^((pp?\.|pages?|vols?\.|volumes?|nos?\.|numbers?)\s*[0-9]|(ibid|op\.?\s*cit|loc\.?\s*cit|passim|et\s+seq)\.?$)"
AUTHOR_YEAR = r"(?i)\((1[0-9]{3}|20[0-9]{2})[a-z]?\)|,\s*(1[0-9]{3}|20[0-9]{2})\b|\bet\s+al\b"
SOURCE = r"(?i)^((sources?|references?)\s+[0-9]|\[\s*[0-9]+\s*\]$)"
CUTS = {"locator": LOCATOR, "numeral": NUMERAL, "apparatus": APPARATUS, "date": DATE, "reference": REFERENCE, "author_year": AUTHOR_YEAR, "source": SOURCE}
# Bounds of the text guard, and the mark of an abstention.
MOST_CHARS, MOST_OTHER, LEAST_LETTERS = 30_000, 0.4, 0.45
ABSTENTION = "not-in-passage"


def folded(surface: Column) -> Column:
    """Fold for candidates: dashes to spaces, other marks and modifier letters away, one space, lower case, `aa` to `a`."""
    s = F.regexp_replace(surface, "[-‐‑‒–—]", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\p{M}_\s]|\p{Lm}", "")
    s = F.lower(F.btrim(F.regexp_replace(s, r"[\s ]+", " ")))
    return F.regexp_replace(s, "aa+", "a")


def title(section: Column) -> Column:
    """A heading in lower case, spaces collapsed, outer marks away."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(section, F.lit(""))), r"\s+", " "), F.lit(" .:-–—"))


def no_content(section: Column) -> Column:
    return title(section).isin(*NO_CONTENT)


def no_evidence(section: Column) -> Column:
    """Whether a heading is front or back matter; a leading page number is looked through, once and again."""
    whole = title(section)

    def told(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^[ivxlcdm]+\.?\s+", "")
        return t.isin(*NO_CONTENT, *NO_EVIDENCE) | t.rlike("^(appendix|annex|notes? to page)") | ((bare != t) & bare.isin(*AFTER_ORDINAL)) | t.rlike(f"({'|'.join(ENDINGS)})$")

    return told(whole) | told(F.regexp_replace(whole, r"^(\d+\s+)+", ""))


def cut_from_names(surface: Column) -> Column:
    out = F.lower(F.trim(surface)) == ABSTENTION
    for p in CUTS.values():
        out |= surface.rlike(p)
    return out


def other_share(text: Column) -> Column:
    """The share of characters that are no letters; null for an empty text."""
    return F.when(F.length(text) > 0, F.lit(1.0) - F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text))


def skip_reason(text: Column) -> Column:
    return F.when(F.length(text) > MOST_CHARS, "size").when(other_share(text) > MOST_OTHER, "letters")


def slug(label: Column, most: int = 80) -> Column:
    """Lower-case words joined by hyphens, cut at the last hyphen within `most`; `section` where nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(F.btrim(label)), "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.substring(s, 1, most)
    short = F.when(F.instr(head, "-") > 1, F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    return F.coalesce(F.nullif(F.when(F.length(s) > most, F.rtrim(short, F.lit("-"))).otherwise(s), F.lit("")), F.lit("section"))


def year_of(source_id: Column) -> Column:
    """The rightmost token of four digits of a source id."""
    return F.element_at(F.filter(F.split(source_id, "-"), lambda t: t.rlike("^[0-9]{4}$")), -1).cast("int")


def isbn13(digits: Column) -> Column:
    """Whether thirteen digits carry their check digit and are not all the same."""
    place = F.sequence(F.lit(1), F.lit(13))
    total = F.aggregate(place, F.lit(0), lambda t, i: t + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(digits.rlike("^[0-9]{13}$") & ~digits.rlike(r"^([0-9])\1{12}$"), total % 10 == 0).otherwise(False)


def duration(seconds: Column) -> Column:
    """Seconds as 1h 02m, 3m 04s or 5.6s."""
    s = F.floor(seconds)
    return (
        F.when(seconds >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
        .when(seconds >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%.1fs", seconds))
    )
