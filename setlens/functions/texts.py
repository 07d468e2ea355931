"""Grammar of descriptions and changes, per-subject conditions, relations and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts' prefixes, closing marks, posture words and path markers.
SELECT_PREFIX = "Identify "
CHANGE_PREFIX = "then retrieve target images where "
CLOSING = ".;:!?"
POSTURES = ("standing", "sitting", "seated", "crouching", "lying down", "walking", "leaning down")
PATH_MARKERS = ("/PIPA/images/", "/images/")
AUXILIARIES = {"are": "is", "were": "was", "have": "has"}
MODIFIERS = ("directly", "immediately", "two spots", "two positions")
SIDES = {"left": "right", "right": "left"}

# what stands between two mentions where a text says on which side of the second one the first is
SIDE_PHRASES = {
    f" {state}{modifier}{word} the {side} of ": side
    for state in ("", *(f"is {now}{posture}" for now in ("", "now ") for posture in ("", *(f"{p} " for p in POSTURES))))
    for modifier in ("", *(f"{m} " for m in MODIFIERS))
    for word in ("to", "on")
    for side in SIDES
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mentions(text: Column) -> Column:
    """Numbers of the subjects a text mentions, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\bSubject\s+(\d+)\b"), F.lit(1)), lambda x: x.cast("int"))


def selection_parts(desc: Column) -> Column:
    """array of struct(subject_id, description); a part without its prefix has a null number."""
    body = F.regexp_replace(desc, f"^{SELECT_PREFIX}", "")
    parts = F.split(body, r"\s+and\s+(?=Subject\s+\d+\s+as\s+)")
    number = lambda p: F.nullif(F.regexp_extract(p, r"^Subject (\d+) as ", 1), F.lit("")).cast("int")
    return F.transform(parts, lambda p: F.struct(number(p).alias("subject_id"), F.trim(F.regexp_replace(p, r"^Subject \d+ as ", "")).alias("description")))


MENTION = r"\bSubject\s+(\d+)\b"
GROUP = r"(?:(?:the\s+)?members\s+of\s+)?"  # may stand before a mention that is one person's


def condition(change: Column, subject: Column) -> Column:
    """The change as seen from one subject: it is the reference person, the others are other referenced persons.

    The text is taken apart at its mentions; each gets its name, and the auxiliary that follows one agrees with it.
    """
    start = F.when(F.lower(change).startswith(CHANGE_PREFIX.strip()), F.regexp_replace(F.substr(change, F.lit(len(CHANGE_PREFIX))), r"^\s+", ""))
    text = trimmed(F.coalesce(F.when(F.substr(change, F.lit(len(CHANGE_PREFIX)), F.lit(1)).rlike(r"\s"), start), change))
    numbers, words = F.regexp_extract_all(text, F.lit(GROUP + MENTION), F.lit(1)), F.split(text, GROUP + MENTION)

    def named(number: Column, after: Column) -> Column:
        name = F.when(number.cast("int") == subject, "the reference person").otherwise(F.concat(F.lit("the other referenced person (Subject "), number, F.lit(")")))
        agreed = after
        for many, one in AUXILIARIES.items():
            agreed = F.when(after.rlike(rf"^ {many}\b"), F.concat(F.lit(f" {one}"), F.substr(after, F.lit(len(many) + 2)))).otherwise(agreed)
        return F.concat(name, agreed)

    return F.concat(words[0], F.array_join(F.zip_with(numbers, F.slice(words, 2, F.size(numbers)), named), ""))


def swapped(change: Column) -> Column:
    """The change with its only left or right relation turned round; null if there is not exactly one between two subjects.

    A relation is a mention, one of SIDE_PHRASES and another mention. A mention ends at most one of two that follow
    each other.
    """
    mention = r"(?i)\bSubject \d+\b"
    found, words = F.regexp_extract_all(change, F.lit(mention), F.lit(0)), F.split(change, mention)
    between = F.slice(words, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    says = F.transform(between, lambda x: F.lower(x).isin(*SIDE_PHRASES))
    step = lambda acc, yes: F.struct(
        (acc["at"] + 1).alias("at"), (yes & ~acc["open"]).alias("open"),
        F.when(yes & ~acc["open"], F.array_append(acc["hits"], acc["at"])).otherwise(acc["hits"]).alias("hits"),
    )
    none = F.struct(F.lit(1).alias("at"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("hits"))
    hits = F.aggregate(says, none, step)["hits"]
    at = F.get(hits, F.lit(0))
    number = lambda k: F.regexp_extract(F.get(found, k), r"\d+", 0)
    phrase = F.get(words, at)
    side = F.regexp_extract(F.lower(phrase), r"(\w+) of $", 1)
    length = F.length(phrase) - F.length(side) - 4
    other = F.when(side == "left", SIDES["left"]).otherwise(SIDES["right"])
    turned = F.concat(F.substr(phrase, F.lit(1), length), other, F.lit(" of "))
    pairs = F.zip_with(found, F.slice(words, 2, F.size(found)), lambda m, w: F.struct(m.alias("m"), w.alias("w")))
    rest = F.transform(pairs, lambda p, i: F.concat(p["m"], F.when(i + 1 == at, turned).otherwise(p["w"])))
    return F.when((F.size(hits) == 1) & (number(at - 1) != number(at)), F.concat(words[0], F.array_join(rest, "")))


def safe_path(url: Column) -> Column:
    """The relative image path of an address: query value d, else its path; null if it is empty or climbs up."""
    asked = F.try_parse_url(url, F.lit("QUERY"), F.lit("d"))
    plain = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    value = F.replace(F.try_url_decode(F.coalesce(asked, plain)), F.lit("\\"), F.lit("/"))
    found = value
    for marker in reversed(PATH_MARKERS):
        found = F.when(F.instr(value, marker) > 0, F.substr(value, F.instr(value, marker) + len(marker))).otherwise(found)
    path = F.regexp_replace(found, "^/+", "")
    return F.when((path != "") & ~F.array_contains(F.split(path, "/"), ".."), path)
