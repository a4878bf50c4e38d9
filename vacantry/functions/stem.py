"""English stems (Porter's second algorithm) as column expressions.

A word of lower-case ASCII letters becomes its stem; any other word stays as it is,
so names such as ``c++`` or ``node.js`` are found as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tables of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: So many letters at a stem's end, at most, are not those of its word (``ble`` for ``biliti``).
CHANGED = 2
V, NOT_V = "[aeiouy]", "[^aeiouy]"
SHORT_SYLLABLE = f"({NOT_V}{V}[^aeiouywxY]|^{V}{NOT_V})$"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cut(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def ends(w: Column, *suffixes: str) -> Column:
    """The longest of the suffixes that the word ends in, else empty."""
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def behind(w: Column) -> Column:
    """How many letters go up to the first consonant behind a vowel; all without one."""
    head = F.length(F.regexp_extract(w, f"^{NOT_V}*{V}+{NOT_V}", 0))
    return F.when(head > 0, head).otherwise(F.length(w))


def plural(w: Column) -> Column:
    some = w.rlike("(ied|ies)$")
    return (
        F.when(w.endswith("sses") | some & (F.length(w) > 4), cut(w, 2)).when(some, cut(w, 1)).when(w.rlike("(us|ss)$"), w).when(w.rlike(f"{V}.+s$"), cut(w, 1)).otherwise(w)
    )


def past(w: Column, r1: Column) -> Column:
    def by(s: Column) -> Column:
        base = cut(w, F.length(s))
        mended = lambda b: (
            F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike(DOUBLE), cut(b, 1))
            .when((F.length(b) <= r1) & b.rlike(SHORT_SYLLABLE), F.concat(b, F.lit("e"))).otherwise(b)
        )
        return (
            F.when(s == "", w).when(s.startswith("eed"), F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w))
            .when(base.rlike(V), let(base, mended)).otherwise(w)
        )

    return let(ends(w, "eedly", "eed", "ingly", "edly", "ing", "ed"), by)


def swapped(w: Column, table: dict[str, str], region: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """The suffix replaced if it lies in the region and what is before it fits."""
    new = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def by(s: Column) -> Column:
        base = cut(w, F.length(s))
        return F.when((s != "") & (F.length(base) >= region) & fits(s, base), F.concat(base, F.coalesce(F.try_element_at(new, s), F.lit("")))).otherwise(w)

    return let(ends(w, *table), by)


def final(w: Column, r1: Column, r2: Column) -> Column:
    base, n = cut(w, 1), F.length(w) - 1
    return F.when(w.endswith("e") & ((n >= r2) | (n >= r1) & ~base.rlike(SHORT_SYLLABLE)) | w.endswith("ll") & (n >= r2), base).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of less than three letters, and with other characters than a to z, stay."""

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        three = lambda s, b: (s != "ative") | (F.length(b) >= r2)
        two = lambda s, b: ((s != "ogi") | b.endswith("l")) & ((s != "li") | b.rlike("[cdeghkmnrt]$"))
        four = lambda s, b: (s != "ion") | b.rlike("[st]$")
        chain = (
            lambda x: past(x, r1), lambda x: F.regexp_replace(x, f"^(.+{NOT_V})[yY]$", "$1i"), lambda x: swapped(x, STEP_2, r1, two), lambda x: swapped(x, STEP_3, r1, three),
            lambda x: swapped(x, dict.fromkeys(STEP_4, ""), r2, four), lambda x: final(x, r1, r2),
        )

        def rest(x: Column, k: int = 0) -> Column:
            return x if k == len(chain) else let(chain[k](x), lambda y: rest(y, k + 1))

        return let(plural(w), lambda x: F.when(x.isin(*KEPT_AFTER_PLURAL), x).otherwise(rest(x)))

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({V})y", "$1Y")
    prefix = lambda w: F.length(F.regexp_extract(w, f"^({'|'.join(LONG_PREFIXES)})", 1))
    first = lambda w: F.when(prefix(w) > 0, prefix(w)).otherwise(behind(w))
    regions = lambda w: let(first(w), lambda r1: let(r1 + behind(F.substring(w, r1 + 1, F.length(w))), lambda r2: steps(w, r1, r2)))
    whole = F.create_map(*[F.lit(x) for pair in WHOLE_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(whole, word), F.when(word.rlike("^[a-z]{3,}$"), F.translate(let(marked, regions), "Y", "y")).otherwise(word))
