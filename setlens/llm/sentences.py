"""Sentence boundaries across languages and scripts, in SQL expressions only.

Points that end nothing (in numbers, names of files, addresses, abbreviations, initials, ordinals and ellipses, and marks
inside quotations and brackets) are replaced by private-use placeholders of the same length. What terminators are left
split the text by the rules of their script, together with blank lines and lines that begin with a list mark. As every
placeholder takes the place of one code point, the offsets of the pieces hold for the text itself, and restoring a
sentence is a substring of it. A quotation or bracket reaches to its closing mark within the paragraph (up to a blank
line), however long it is.

Defined cases: a null, empty or blank text has no sentences; private-use characters of a text stay in it (they are only
hidden while it is split); repeated rows give repeated sentences; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, CUT, OPEN, CLOSE, IN, OUT, LIST, ITEM, FOREIGN = (chr(0xE000 + k) for k in range(9))
MARKS = ".!?。！？．؟۔।॥｡;"
ALWAYS = "!?。！？．؟۔।॥｡;"
# The white space of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
STARTS = 256  # pieces whose starts are summed in one go

# Abbreviations that never end a sentence, and those that do not before a number.
NEVER = (
    "Dr Prof Mr Mrs Ms St Dept Sr Sra Srta Dra Hr Mme Mlle Gen Col Lt Sgt Capt Rev Hon approx aprox appr ca cf vgl vs incl"
    " inkl excl exkl bzw env ex ej sog evtl ggf resp прим см ср напр проф тов им δηλ βλ डॉ पं प्रो श्री श्रीमती"
)
BEFORE_NUMBER = (
    "No no Nos nos Nr nr n N Fig fig Figs figs Vol vol Vols vols ver Ver v sec Sec p pp P ch Ch chap Chap art Art Abb Abschn Kap"
    " pág págs Pág núm Núm Bd Tab tab Aufl S Z t éd рис стр гл табл № εικ σελ κεφ αρ"
)
# In several parts, with # for each point but the last.
PARTS = "z# B|z#B|d# h|d#h|u# a|u#a|i# d|i#d|o# ä|p# ej|p#ej|p# ex|p#ex|т# е|т#е|т# к|т#к|e# g|e#g|i# e|i#e|a#k#a|a# k# a|π#χ|π# χ"
MONTHS = (
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sept Sep Okt Nov Dez"
)

_WORD = r"(?<![\p{L}\p{M}\p{N}])"
# possessive, so that Java takes a long one without recursion
_QUOTED = r"((?:[^%s%s\n]|\n(?![^\S\n]*\n))++)"


def _alternatives(words: str) -> str:
    """The words as alternatives; accents may also be written as combining marks."""
    import unicodedata

    forms = {f for w in words.split() for f in (w, unicodedata.normalize("NFD", w))}
    return "|".join(sorted(forms, key=lambda w: (-len(w), w)))


def _masks() -> list[tuple]:
    """(text that must be there for the step, pattern, replacement); enclosed marks come with both placeholders as well.

    The first is a list of which one must stand in the text, or none: a look for plain text is much cheaper than a pattern.
    """
    m, w = MASK, _WORD
    parts = PARTS.replace("#", f"[.{m}]").replace(" ", r"\s")
    first_points = "|".join(
        [
            # numbers, names of files, addresses, versions: a point or mark between characters of one name
            r"[.?!](?=[a-z0-9_/%&=~])(?<=[A-Za-z0-9_/%&=~+-].)(?<![a-z]{2}[?!])",
            r"．(?=\d)(?<=\d．)",
            # letters of an abbreviation or initials written together
            rf"\.(?=\p{{L}}[.{m}])(?<={w}\p{{L}}\.)",
            # ellipses
            r"\.(?:(?=\.)|(?<=\.\.))",
        ]
    )
    last_points = "|".join(
        [
            rf"(?=\s?(?:ej|ex|[BhadäекgkeχBA])\.)(?<={w}[pzduioтeaπ]\.)",
            rf"(?<={w}(?:{parts})\.)",
            rf"(?<={w}(?:{_alternatives(NEVER)})\.)",
            rf"(?=\s*[#№]?\d)(?<={w}(?:{_alternatives(BEFORE_NUMBER)})\.)",
            r"(?=[º°ª])(?<=[nN]\.)",
            # both points of a. m. and p. m., т. д., т. п.: the second may end a sentence
            rf"(?=\s?[mдп]\.)(?<={w}[apт]\.)",
            # initials, and one letter before a number
            rf"(?=\s*[\p{{L}}(])(?<={w}\p{{Lu}}\.)",
            # ordinals
            rf"(?=\s+(?:{_alternatives(MONTHS)})\b)(?<=\d\.)",
            r"(?=\s+\p{L})(?<=\b(?:[Aa]m|[Vv]om|[Zz]um|[Dd]er|[Dd]em|[Dd]en|[Dd]ie|[Dd]as|[Ii]m|[Bb]eim|[Ss]eit)\s\d{1,3}\.)",
        ]
    )
    quotations = f"{OPEN}$1{CLOSE}"
    return [
        (["\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006", "\ue007", "\ue008"], f"[{MASK}-{FOREIGN}]", FOREIGN),
        ([".", "?", "!", "．"], first_points, m),
        ([m], rf"\.(?=\p{{L}}(?!\p{{Ll}}))(?<={w}\p{{L}}{m}\p{{L}}\.)", m),
        ([f"{m}."], rf"\.(?=\s+\p{{Ll}})(?<={m}\.)", m),
        # a time that opens a sentence goes on
        ([f"{m}m."], rf"\.(?<={w}(?:At|By|Around|Before|After|Until|From)\s\d{{1,2}}(?:[:{m}]\d\d)?\s[ap]{m}m\.)", m),
        (["m."], rf"(?=A\sla){w}(A\slas?\s\d{{1,2}}(?:[:{m}]\d\d)?\s[ap])\.(\s?)m\.", f"$1{m}$2m{m}"),
        (["."], rf"\.(?:{last_points})", m),
        # quotations
        (['"'], rf'(?<![\p{{L}}\p{{N}}])"(?=\S){_QUOTED % (chr(34), "")}(?<=\S)"', quotations),
        (["'"], rf"(?<![\p{{L}}\p{{M}}\p{{N}}])'(?=\S){_QUOTED % (chr(39), '')}(?<=\S)'(?![\p{{L}}\p{{N}}])", quotations),
        (["„"], rf"„{_QUOTED % ('“', '”„')}[“”]", quotations),
        *[([b], rf"{a}{_QUOTED % (a, b)}{b}", quotations) for a, b in ("“”", "«»", "「」", "『』", "‘’", "‹›")],
        ([CLOSE], rf"[{MARKS}](?![{MARKS}…{MASK}]*\s?\z)", m, OPEN, CLOSE),
        # brackets inside a sentence
        (
            list(")]）】"),
            rf"[(\[（【](?<!^\s{{0,4}}.)(?<![{MARKS}{CLOSE})）]\s{{0,4}}[(\[（【])(?<!\n[ \t\r]{{0,4}}\n\s{{0,4}}[(\[（【])"
            rf"{_QUOTED % (r'()\[\]', '（）【】')}[)\]）】]",
            f"{IN}$1{OUT}",
        ),
        ([OUT], f"[{MARKS}]", m, IN, OUT),
    ]


_BLANK = r"[^\S\n\r]"
_LINE = r"(?:\r\n|[\n\r\x85  ])"
_BULLET = r"[-–*•·◦‣▪●○][ \t 　]+\S"
_NUMBER = r"\(?\d{1,3}[.)、．][ \t 　]+\S"
HARD = [
    # a blank line
    (["\n", "\r", "\x85", "\u2028", "\u2029"], rf"{_LINE}[^\S\n\r]*{_LINE}\s*", f"$0{CUT}"),
    # a line with a list mark: bullets anywhere, numbers where the line before is over or is itself such a line
    (list("-–*•·◦‣▪●○"), rf"(?m)(?:^|(?<={CUT}))([^\S\n\r]*{_BULLET}[^\n\r]*)$", f"{CUT}{LIST}$1{CUT}"),
    (["\n"], r"(?<=\n)[ ]{0,4}\d{1,3}[.)] [^\n]*\n", f"$0{ITEM}"),
    (
        list(".)、．"),
        rf"(?m)(?={_BLANK}{{0,9}}\(?\d{{1,3}}[.)、．]\s)(?:(?<=\A[{CUT}\s]{{0,4}})|(?<=[{MARKS}:{CLOSE}{CUT})][^\S\n\r]{{0,4}}\r?\n)|(?<={ITEM})|(?<={CUT}))"
        rf"([^\S\n\r]*{_NUMBER}[^\n\r]*)$",
        f"{CUT}{LIST}$1{CUT}",
    ),
    ([ITEM], ITEM, ""),
]

_QUOTE_ENDS = f"{CLOSE}”»」』’›"
_BRACKET_ENDS = r")\]）】"
_NEXT_OPENS = rf"[¿¡{OPEN}{IN}(\[（【«“„「『‘\"'—–-]*\s?"
ENDS = rf"(?=[{MARKS};])(?:" + "|".join(
    [
        # after a closing quotation mark it goes on unless a capital follows
        rf"[{MARKS}]+\s?[{_QUOTE_ENDS}]+[{_BRACKET_ENDS}]*(?=\s*{_NEXT_OPENS}[\p{{Lu}}\p{{Lt}}]|\s*$)",
        rf"[{MARKS}]+[{_BRACKET_ENDS}]+(?=\s|$|\p{{Lu}})",
        rf"[{ALWAYS}][{MARKS}…{MASK}]*+(?!\s?[{_QUOTE_ENDS}]|[{_BRACKET_ENDS},;:，；،؛])",
        rf"\.(?=\s+[^\s\p{{Ll}}]|\s*$)(?!\s?[{_QUOTE_ENDS}])",
        # white space may be missing
        rf"\.(?={_NEXT_OPENS}\p{{Lu}}(?:[\p{{Ll}}\p{{M}}\s]|$))(?<=[\p{{Ll}}\p{{M}}\d)\]{CLOSE}{OUT}%]\.)",
        rf"\.(?=[\p{{Lo}}&&[^ºª]])(?<=[\p{{L}}\p{{M}}\d)\]{CLOSE}{OUT}%]\.)",
        # Greek question mark
        rf";(?!\s?[{_QUOTE_ENDS}])(?<=\p{{IsGreek}}[\p{{M}}\d\s)\]{CLOSE}{OUT}]{{0,6}};)",
        rf";(?<=\p{{IsGreek}}\p{{M}}{{0,2}};)\s?[{_QUOTE_ENDS}]+(?=\s*{_NEXT_OPENS}[\p{{Lu}}\p{{Lt}}]|\s*$)",
    ]
) + ")"
THAI = r"(?<=\p{IsThai})\s+(?=\p{IsThai})"
THAI_BYTES = (b"\xe0\xb8", b"\xe0\xb9")  # with which all letters of the script begin


def has_any(text: Column, needles: list) -> Column:
    found = [F.contains(text, F.lit(x)) for x in needles]
    return reduce(lambda x, y: x | y, found)


def within(text: Column, pattern: str, by: str, opening: str, closing: str) -> Column:
    """text with pattern replaced wherever closing is the next of the two placeholders, in time linear in the text."""
    last = F.substring_index(text, closing, -1)
    closed = F.split(F.substr(text, F.lit(1), F.length(text) - F.length(last) - 1), closing)

    def part(x: Column) -> Column:
        tail = F.substring_index(x, opening, -1)
        return F.concat(F.substr(x, F.lit(1), F.length(x) - F.length(tail)), F.regexp_replace(tail, F.lit(pattern), F.lit(by)))

    return F.concat(F.array_join(F.transform(closed, part), closing), F.lit(closing), last)


def with_pieces(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with an array of pieces that follow each other without gap; each has the length of its part of the text."""
    now = text
    for k, (needles, pattern, by, *enclosed) in enumerate([*_masks(), *HARD]):
        # as a column of its own, the text so far is made once
        before, now = F.col(now), f"_masked{k}"
        step = within(before, pattern, by, *enclosed) if enclosed else F.regexp_replace(before, F.lit(pattern), F.lit(by))
        docs = docs.withColumn(now, F.when(has_any(before, needles), step).otherwise(before))

    def ends(segment: Column, pattern: str) -> Column:
        return F.split(F.regexp_replace(segment, F.lit(f"(?U){pattern}"), F.lit(f"$0{CUT}")), CUT)

    def inner(pattern: str):
        return lambda s: F.when(s.startswith(LIST), F.array(F.substr(s, F.lit(2)))).otherwise(ends(s, pattern))

    segments = F.split(now, CUT)
    thai = has_any(F.col(now).cast("binary"), list(THAI_BYTES))
    pieces = F.when(thai, F.transform(segments, inner(f"{ENDS}|{THAI}"))).otherwise(F.transform(segments, inner(ENDS)))
    docs = docs.withColumn(name, F.flatten(pieces))
    return docs.drop(*[c for c in docs.columns if c.startswith("_masked")])


def running_starts(lengths: Column) -> Column:
    """Sum of the lengths before each; summed in groups, so that no long array is copied once per element."""
    count = F.size(lengths)
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(count / STARTS).cast("int") - 1, F.lit(0))), lambda g: F.slice(lengths, g * STARTS + 1, STARTS)
    )
    none = F.array().cast("array<int>")
    zero = lambda at: F.struct(at.alias("at"), none.alias("starts"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
    total = lambda g: F.aggregate(g, F.lit(0), lambda acc, n: acc + n)
    firsts = F.aggregate(F.transform(groups, total), zero(F.lit(0)), step)["starts"]
    within = F.zip_with(groups, firsts, lambda g, first: F.aggregate(g, zero(first), step)["starts"])
    return F.when(count > 0, F.flatten(within)).otherwise(none)


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, start_pos, end_pos, sentence): offsets in code points; end is one past the last non-blank character."""
    cut_up = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut_up = with_pieces(cut_up, "text", "pieces")
    sized = cut_up.select(
        "id", "text",
        F.transform(
            "pieces",
            lambda p: F.struct(
                F.length(p).alias("n"),
                (F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))).alias("lead"),
                F.length(F.rtrim(p, F.lit(BLANKS))).alias("end"),
            ),
        ).alias("sizes"),
    )
    placed = sized.withColumn("starts", running_starts(F.col("sizes.n")))
    spans = F.zip_with(
        "sizes", "starts", lambda s, at: F.struct((at + s["lead"]).alias("start_pos"), (at + s["end"]).alias("end_pos"))
    )
    found = placed.select("id", "text", F.posexplode(F.filter(spans, lambda s: s["start_pos"] < s["end_pos"])).alias("seq", "s"))
    start, end = F.col("s.start_pos"), F.col("s.end_pos")
    return found.select(
        "id", "seq", start.cast("bigint").alias("start_pos"), end.cast("bigint").alias("end_pos"),
        F.substr(F.col("text"), start + 1, end - start).alias("sentence"),
    )
