"""String, HTML and URL functions over columns. Nulls count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an application link looks like, and what is mined from texts.
APPLY_URL = r"(?i)^(?:https?://\S|mailto:\S+@\S+)"
HREF = r"(?i)href=[\"']([^\"']+)[\"']"
URL = r"(?i)https?://[^\s\"'<>)]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: Fixed value: whole lines of job boards that are not part of a posting.
PAGE_LINE = (
    r"(?i)^(?:•\s*)?(?:apply\s*now|apply\s+before.*|share\s*(?:this)?\s*(?:job)?|share\s+on\s+\w+|job\s+overview|views?\s*:.*"
    r"|no\.?\s*of\s+vacanc\w*\s*:?.*|tweet|print(?:\s+this)?(?:\s+job)?|save(?:\s+this)?(?:\s+job)?|report\s+this\s+job|back\s+to\s+(?:jobs|listings?))\s*$"
)
#: Fixed value: character references and what they stand for, in the order of replacement.
REFERENCES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))
#: Fixed value: the characters of Unicode's property White_Space, as ``(?U)\\s`` matches them.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters of a description that its hash takes, in hash form.
HASHED = 100
#: Fixed value: a text's start with enough letters and digits for ``HASHED``; the two that aren't ASCII give i and k in lower case.
HASHED_START = rf"^(?:[^A-Za-z0-9\u0130\u212a]*+[A-Za-z0-9\u0130\u212a]){{0,{HASHED + 1}}}+"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """White space (Unicode) made single, trimmed."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at the ends; a pattern would be tried at every character."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def unix_lines(c: Column) -> Column:
    """Line ends as line feeds."""
    return F.replace(F.replace(text(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines_of(c: Column) -> Column:
    return F.split(unix_lines(c), "\n")


def clean_block(c: Column) -> Column:
    """Each line cleaned; runs of blank lines become one; no blank ends."""
    joined = F.array_join(F.transform(lines_of(c), clean_text), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def clean_document(c: Column) -> Column:
    """As ``clean_block`` for texts from documents: ligatures, dashes and hard spaces become plain; only blanks and tabs are squashed."""
    plain = F.replace(F.replace(F.translate(text(c), " –—", " --"), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    joined = F.array_join(F.transform(lines_of(plain), lambda line: F.trim(F.regexp_replace(line, r"[ \t]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def html_to_text(c: Column) -> Column:
    """An HTML fragment's text: ends of blocks break lines, list items get bullets, blank lines go."""
    broken = F.regexp_replace(text(c), r"(?i)<\s*(?:br|/p|/div|/li|/h[1-6])\s*/?>", "\n")
    bare = F.regexp_replace(F.regexp_replace(broken, r"(?i)<\s*li[^>]*>", "\n• "), r"<[^>]+>", " ")
    for reference, char in REFERENCES:
        bare = F.replace(bare, F.lit(reference), F.lit(char))
    rows = F.transform(F.split(bare, "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(rows, lambda line: line != ""), "\n")


def tidy_description(c: Column) -> Column:
    """Without the lines that the board put around the posting."""
    kept = F.filter(F.split(text(c), "\n"), lambda line: ~F.regexp_replace(line, r"(?U)^\s+|\s+$", "").rlike(PAGE_LINE))
    squashed = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)(\n\s*)(?:\n\s*)+(?=\n|$)", "$1")
    return F.regexp_replace(squashed, r"(?U)^\s+|\s+$", "")


def clean_apply_url(c: Column, source_url: Column) -> Column:
    """A link to apply by (http, https, mailto; 600 characters at most), or null; the posting's own address is none."""
    link = clean_text(c)
    return F.when(link.rlike(APPLY_URL) & (F.length(link) <= 600) & (link != clean_text(source_url)), link)


def find_apply_link(*fragments: Column) -> Column:
    """The first usable href of the fragments in order, else the first address in their text, else the first mail address."""
    hrefs = F.flatten(F.array(*[F.regexp_extract_all(text(f), F.lit(HREF), F.lit(1)) for f in fragments]))
    good = F.filter(F.transform(hrefs, lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", "")), lambda h: h.rlike(APPLY_URL))
    joined = F.array_join(F.filter(F.array(*[clean_text(f) for f in fragments]), lambda t: t != ""), " ")
    url = F.regexp_replace(F.regexp_extract(joined, URL, 0), r"[.,;:)\]}>\"']+$", "")
    mail = F.regexp_extract(joined, EMAIL, 0)
    return F.coalesce(F.get(good, F.lit(0)), blank_to_null(url), F.when(mail != "", F.concat(F.lit("mailto:"), mail)))


def hash_form(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 made single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def dedupe_hash(title: Column, company: Column, description: Column) -> Column:
    """SHA-256 of title, company and the first 100 characters of the description, all in hash form; of the description no more is read."""
    start = F.regexp_extract(text(description), HASHED_START, 0)
    return F.sha2(F.concat_ws("|", hash_form(title), hash_form(company), F.substring(hash_form(start), 1, HASHED)), 256)


def distinct_list(values: Column, limit: int | None = 40) -> Column:
    """Cleaned values without blanks; of values that differ by case only the first stays; ``limit`` at most."""
    cleaned = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text), lambda v: v != "")
    lowered = F.transform(cleaned, F.lower)
    firsts = F.filter(
        F.transform(cleaned, lambda v, i: F.when(F.array_position(lowered, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull()
    )
    return firsts if limit is None else F.slice(firsts, 1, limit)


def union_lists(*lists: Column) -> Column:
    """One list after the other as one distinct list, the first spelling kept."""
    return distinct_list(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), None)


def without(values: Column, other: Column) -> Column:
    """Values that the other list has in no spelling of case."""
    lowered = F.transform(F.coalesce(other, F.array().cast("array<string>")), F.lower)
    return F.filter(values, lambda v: ~F.array_contains(lowered, F.lower(v)))


def union_sources(sources: Column) -> Column:
    """Structs ``platform, url`` without blank urls, the first of each url; a blank platform is ``unknown``."""
    cleaned = F.filter(
        F.transform(sources, lambda s: F.struct(F.coalesce(blank_to_null(clean_text(s["platform"])), F.lit("unknown")).alias("platform"), clean_text(s["url"]).alias("url"))),
        lambda s: s["url"] != "",
    )
    urls = F.transform(cleaned, lambda s: s["url"])
    return F.filter(F.transform(cleaned, lambda s, i: F.when(F.array_position(urls, s["url"]) == i + 1, s)), lambda s: s.isNotNull())


def all_sources(platform: Column, url: Column, sources: Column) -> Column:
    """The primary source and the others, the first of each url."""
    return union_sources(F.concat(F.array(F.struct(platform.alias("platform"), url.alias("url"))), F.coalesce(sources, F.array().cast("array<struct<platform:string,url:string>>"))))


def link_host(c: Column) -> Column:
    """The host of a link without ``www.``, or the address of a mail link."""
    host = F.regexp_replace(F.lower(F.regexp_extract(text(c), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), r"^www\.", "")
    rest = F.regexp_extract(F.regexp_replace(text(c), r"(?i)^https?://", ""), r"^[^/]*", 0)
    return F.when(c.rlike("(?i)^mailto:"), F.trim(F.regexp_replace(text(c), "(?i)^mailto:", ""))).otherwise(
        F.coalesce(blank_to_null(host), blank_to_null(rest), F.lit("the source site"))
    )


def title_case(c: Column) -> Column:
    """``-`` and ``_`` become spaces; each word's first letter is a capital, the rest stays."""
    spaced = F.regexp_replace(text(c), "[-_]+", " ")
    pieces = F.regexp_extract_all(spaced, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def label_for(c: Column, labels: dict[str, str], fallback: str = "") -> Column:
    """The label of a value, else its title case; ``fallback`` for a blank."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None
    named = F.coalesce(F.try_element_at(known, c), title_case(c)) if known is not None else title_case(c)
    return F.when(text(c) == "", F.lit(fallback)).otherwise(named)


def paragraphs(c: Column) -> Column:
    """The blocks between blank lines, trimmed, without empty ones."""
    blocks = F.transform(F.split(text(c), r"\r?\n\s*\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(blocks, lambda b: b != "")


def string_list(c: Column) -> Column:
    """A JSON text of null, a string or a list as a list of trimmed strings without blanks."""
    listed = F.from_json(c, "array<string>")
    single = F.array(F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(1)), c))
    items = F.when(c.isNull() | (F.trim(c) == "null"), F.array().cast("array<string>")).when(F.trim(c).startswith("["), listed).otherwise(single)
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_text), lambda v: v != "")
