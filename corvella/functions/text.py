"""Text functions on columns.

Language rules (prefix letters, final-letter folding, suffixes) come in a
Rules value, so that a corpus without such morphology uses NO_RULES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D\x20]+"
UNICODE_SPACE = r"(?U)\s+"
# Direction marks, and with them other characters that are not seen.
DIRECTIONS = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
INVISIBLE = DIRECTIONS + "\u200b\ufeff"
# White space of any alphabet, all that (?U)\s matches.
WHITE = " \n\t\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Marks stripped from both ends of a word.
EDGE_MARKS = "?.,:;!\"'()[]"


@dataclass(frozen=True)
class Rules:
    """prefixes: letters that may stand before a word. finals: final letter -> base letter. suffixes of one and two letters."""

    prefixes: str = ""
    finals: tuple[str, str] = ("", "")
    suffixes1: tuple[str, ...] = ()
    suffixes2: tuple[str, ...] = ()


NO_RULES = Rules()
# Hebrew one-letter prefixes, final forms and their base letters, suffixes.
HEBREW = Rules("הובלמכש", ("םןץףך", "מנצפכ"), ("ה", "ת"), ("ים", "ות"))


def words(text: Column, unicode: bool = False) -> Column:
    """Words between white space; an empty array for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), UNICODE_SPACE if unicode else SPACE), "")


def stripped(text: Column) -> Column:
    """text without white space, of any alphabet's, at its ends."""
    return F.btrim(text, F.lit(WHITE))


def clean(text: Column) -> Column:
    """text without white space and direction marks at its ends."""
    return stripped(F.btrim(stripped(text), F.lit(DIRECTIONS)))


def normal_space(text: Column) -> Column:
    return F.array_join(words(text), " ")


def bare(word: Column, marks: str = EDGE_MARKS) -> Column:
    """word without marks at its ends."""
    return F.btrim(word, F.lit(marks))


def fold(text: Column, rules: Rules = NO_RULES) -> Column:
    text = F.lower(text)
    return F.translate(text, *rules.finals) if rules.finals[0] else text


def term_variants(word: Column, rules: Rules = NO_RULES) -> Column:
    """Forms under which a term may stand in text, as an array; empty for words under three letters.

    Prefix letters go one by one while more than three letters are left; a
    suffix letter goes from words over four, a pair from words over five. A
    suffix is compared after final letters are folded, so suffixes that end in
    a final form never match.
    """
    base = fold(bare(word), rules)
    forms = F.array(base)
    if rules.prefixes:
        run = F.length(F.regexp_extract(base, f"^[{rules.prefixes}]*", 0))
        cuts = F.least(run, F.length(base) - 3)
        forms = F.concat(forms, F.when(cuts > 0, F.transform(F.sequence(F.lit(1), cuts), lambda i: F.substring(base, i + 1, 1_000_000))).otherwise(F.array().cast("array<string>")))
    whole = forms
    for suffixes, least, size in ((rules.suffixes1, 4, 1), (rules.suffixes2, 5, 2)):
        if suffixes:
            forms = F.concat(forms, F.transform(F.filter(whole, _ends_with(suffixes, least, size)), _without(size)))
    return F.when(F.length(base) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(forms))


def _ends_with(suffixes: tuple[str, ...], least: int, size: int):
    return lambda form: (F.length(form) > least) & F.right(form, F.lit(size)).isin(*suffixes)


def _without(size: int):
    return lambda form: F.left(form, F.length(form) - size)


def matches(text: Column, pattern: str, **groups: int) -> Column:
    """array of struct(start, before, text, and each named group): all matches of a pattern, left to right, without overlap.

    start: characters before the match. before: what lies between the last
    match and this one. A group that took no part is empty. The pattern must
    not match the empty string. Null texts give null. Positions are a running
    length over a text's matches, so long texts are best cut into lines first.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups.values())])
    found = F.filter(parts, lambda x: x["1"].isNotNull())  # the last part is what follows the last match
    kind = "array<struct<start:int,before:string,text:string" + "".join(f",{g}:string" for g in groups) + ">>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["0"])
        one = F.struct(start.alias("start"), x["0"].alias("before"), x["1"].alias("text"), *[x[str(i)].alias(g) for i, g in enumerate(groups, 2)])
        return F.struct((start + F.length(x["1"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(found, zero, step, lambda s: s["out"])


def contains_any(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.contains(text, v))


def comma_list(text: Column) -> Column:
    """The parts of a comma-separated list, without white space around them; empty ones go. Null gives an empty list."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), ","), stripped), "")


def of_length(values: Column, n: Column, fill: Column) -> Column:
    """An array cut or filled up to n elements; null counts as empty."""
    held = F.slice(F.coalesce(values, F.array().cast("array<boolean>")), F.lit(1), F.greatest(n, F.lit(0)))
    return F.concat(held, F.array_repeat(fill, F.greatest(n - F.size(held), F.lit(0))))


def all_groups(text: Column, groups: Column) -> Column:
    """Whether each group (array of alternatives) has one that text contains."""
    return F.forall(groups, lambda g: F.exists(g, lambda v: F.contains(text, v)))


def slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(title, r"[^\w֐-׿-]", "-"), 1, 60)


def order_digits(url: Column) -> Column:
    """The first run of four to seven digits in a URL's last path segment, or null."""
    last = F.element_at(F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda p: p != ""), -1)
    found = F.regexp_extract(last, r"[0-9]{4,7}", 0)
    return F.when(found != "", found)


def private(question: Column) -> Column:
    """Whether a text looks personal: over 100 characters, or five digits in a row once spaces and hyphens are gone."""
    return (F.length(question) > 100) | F.regexp_replace(question, r"[\s\-]+", "").rlike(r"[0-9]{5,}")


def refused(answer: Column, markers: list[str], within: int = 80) -> Column:
    """Whether one of the markers begins within the first characters."""
    at = [F.instr(answer, m).between(1, within) for m in markers]
    out = F.lit(False)
    for a in at:
        out = out | a
    return out


def short_key(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, size)


def clause_key(section: Column, clause: Column) -> Column:
    """Page-map key of a row: w<first window> for raw windows, else section:clause."""
    return F.when(F.startswith(section, F.lit("chunk")), F.concat(F.lit("w"), F.element_at(F.split(clause, "–"), 1))).otherwise(F.concat_ws(":", section, clause))


# Suffixes that curation stems lose.
CURATION_SUFFIXES = ("ים", "ות", "יים", "ה", "י", "ן", "ך", "ו")


def curation_stems(text: Column, rules: Rules = HEBREW, letters: str = "א-ת", suffixes: tuple[str, ...] = CURATION_SUFFIXES) -> Column:
    """Distinct forms of the words of three letters or more: as folded, without one prefix letter, and each without each suffix that leaves over two letters."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"[{letters}]{{3,}}"), F.lit(0)), lambda w: F.translate(w, *rules.finals))
    bare_forms = F.transform(F.filter(found, lambda w: (F.length(w) > 3) & w.rlike(f"^[{rules.prefixes}]")), lambda w: F.substring(w, 2, 1_000_000))
    forms = F.concat(found, bare_forms)
    cut = [F.transform(F.filter(forms, _long_with(x)), _without(len(x))) for x in suffixes]
    return F.array_sort(F.array_distinct(F.concat(forms, *cut)))


def _long_with(suffix: str):
    return lambda form: (F.length(form) > len(suffix) + 2) & F.endswith(form, F.lit(suffix))


def json_debris(text: Column) -> Column:
    """Whether a text ends or continues in left-over JSON punctuation."""
    return text.rlike(r"""[\]}]\s*[\]},]|"\s*[\]}]|[\]}]\s*"$""")


def new_topic(candidate: Column, source: Column, families: list[list[str]]) -> Column:
    """Whether some family of terms turns up in the candidate and none of it in the source."""
    out = F.lit(False)
    for terms in families:
        listed = F.array(*map(F.lit, terms))
        out = out | (contains_any(candidate, listed) & ~contains_any(source, listed))
    return out


@dataclass(frozen=True)
class Verdicts:
    """How rulings are worded: patterns for negations, terms, terms against which a negated one turns, and conditions."""

    missing: str
    negations: str
    terms: str
    forbidding: str
    permitting: str
    partial: tuple[str, ...]
    conditions: str


# The wording of Hebrew rulings.
HEBREW_VERDICTS = Verdicts(
    missing="לא נמצא",
    negations="לא|אינני|אינכם|אינכן|אינך|אינו|אינה|אינם|אינן|איני",
    terms=r"מותר|אסור|מוסמך|רשאי|זכאי|פטור|חייב|ניתן|אפשר|מגיע(?:\s+ל[ךי])?",
    forbidding="אסור",
    permitting="מותר|רשאי|זכאי|מוסמך|פטור|מגיע",
    partial=("בתנאים", "חלקית"),
    conditions=r"אך ורק|ובלבד|בכפוף|בתנאי|למעט|בחריגים|באישור|אלא אם|(?:^|\s)רק(?=\s)",
)


def verdict_class(clause: Column, v: Verdicts) -> Column:
    """yes, no, cond, none or accent (nothing recognised, or a negated prohibition) for one clause of a ruling.

    A clause opens with a term, perhaps negated. What follows makes it
    conditional if it says so, or names a term of the other sense.
    """
    clause = F.trim(clause)
    pattern = rf"^((?:{v.negations})\s+)?({v.terms})(.*)$"
    negated, term = F.regexp_extract(clause, pattern, 1) != "", F.regexp_extract(clause, pattern, 2)
    tail = F.trim(F.regexp_extract(clause, pattern, 3))
    refuses = negated | (term == v.forbidding)
    partly = F.lit(False)
    for word in v.partial:
        partly = partly | F.startswith(tail, F.lit(word))
    turned = F.when(refuses, tail.rlike(v.permitting)).otherwise(F.contains(tail, F.lit(v.forbidding)) | tail.rlike(v.conditions))
    return (
        F.when(F.startswith(clause, F.lit(v.missing)), "none")
        .when((term == "") | (negated & (term == v.forbidding)), "accent")
        .when(partly | turned, "cond")
        .otherwise(F.when(refuses, "no").otherwise("yes"))
    )
