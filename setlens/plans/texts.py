"""Text grammar, conditions, relations, addresses and index lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions import texts as t
from setlens.operators.relational import issues
from setlens.plans import catalog as c
from setlens.plans.catalog import with_cte
from setlens.shared import table
from setlens.sources.index import parse_index


def _ids(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def subject_mentions(spark: SparkSession, d: str) -> DataFrame:
    s = c.samples(spark, d)
    return s.select("sample_id", _ids(t.mentions(F.col("final_desc"))).alias("in_desc"), _ids(t.mentions(F.col("final_change"))).alias("in_change"))


def text_issues(spark: SparkSession, d: str) -> DataFrame:
    """Codes of what is wrong with (description, change); every seventh change is given a fault, so that all rules are used."""
    s = c.samples(spark, d).withColumn("k", F.substring("sample_id", -2, 2).cast("int") % 7)
    s = s.withColumn("desc", F.when(F.col("k") == 1, F.concat("final_desc", F.lit("."))).when(F.col("k") == 2, F.replace("final_desc", F.lit("Identify "), F.lit("Find "))).otherwise(F.col("final_desc")))
    s = s.withColumn("change", F.when(F.col("k") == 3, F.concat("final_change", F.lit("!"))).when(F.col("k") == 4, F.replace("final_change", F.lit("Subject 1"), F.lit("Subject 3"))).otherwise(F.col("final_change")))
    n = F.size("subjects")
    want = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: x)
    code = issues(
        desc_prefix=~F.col("desc").startswith(t.SELECT_PREFIX), change_prefix=~F.col("change").startswith(t.CHANGE_PREFIX),
        desc_closing=F.col("desc").rlike(r"[.;:!?]$"), change_closing=F.col("change").rlike(r"[.;:!?]$"),
        desc_subjects=t.mentions(F.col("desc")) != want,
        change_subjects=F.array_sort(F.array_distinct(t.mentions(F.col("change")))) != want,
        several_lines=F.col("desc").rlike(r"[\r\n]") | F.col("change").rlike(r"[\r\n]"),
    )
    return s.select("sample_id", code.alias("issues")).where("issues <> ''")


def parse_selection(spark: SparkSession, d: str) -> DataFrame:
    p = c.samples(spark, d).select("sample_id", F.explode(t.selection_parts(F.col("final_desc"))).alias("p"))
    return p.select("sample_id", "p.subject_id", "p.description")


def compose_instruction(spark: SparkSession, d: str) -> DataFrame:
    return c.samples(spark, d).select("sample_id", F.concat("final_desc", F.lit("; "), "final_change", F.lit(".")).alias("instruction"))


def subject_conditions(spark: SparkSession, d: str) -> DataFrame:
    s = c.samples(spark, d).select("sample_id", "final_change", F.explode("subjects.subject_id").alias("subject_id")).distinct()
    return s.select("sample_id", "subject_id", t.condition(F.col("final_change"), F.col("subject_id")).alias("condition"))


def direction_swap(spark: SparkSession, d: str) -> DataFrame:
    """Changes with one left/right relation turned round; the tables say "stands left of", so the wording is adapted first."""
    s = c.samples(spark, d).withColumn("change", F.regexp_replace("final_change", r"stands (left|right) of", "is standing to the $1 of"))
    return s.select("sample_id", t.swapped(F.col("change")).alias("swapped")).where("swapped IS NOT NULL")


def url_paths(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "images").where("path IS NOT NULL").select("image_id", "path").distinct()
    k = F.substring("image_id", -2, 2).cast("int") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("/data/local-files/?d=set/PIPA/images/"), F.url_encode("path")))
        .when(k == 1, F.concat(F.lit("http://host.invalid/x/images/"), "path"))
        .when(k == 2, F.concat(F.lit("/images/"), F.replace("path", F.lit("/"), F.lit("\\"))))
        .when(k == 3, F.concat(F.lit("/images/../"), "path"))
        .otherwise(F.concat(F.lit("//"), "path"))
    )
    return i.select("image_id", "path", t.safe_path(F.when(k == 4, F.substr(url, F.lit(2))).otherwise(url)).alias("safe"))


def index_images(spark: SparkSession, d: str) -> DataFrame:
    """Index lines (album photo x y w h identity flag) written from the boxes and read again: images with their identities."""
    b = c.boxes(spark, d).where("identity_id IS NOT NULL")
    line = F.concat_ws(" ", F.split("image_id", "_")[0], F.split("image_id", "_")[1], "x", "y", "width", "height", "identity_id", F.lit("0"))
    parsed = parse_index(b.select(line.alias("value")))
    return parsed.groupBy("image_id").agg(F.countDistinct("identity_id").alias("identities"), F.count(F.lit(1)).alias("row_count"))


QUERIES = {
    f.__name__: f
    for f in (subject_mentions, text_issues, parse_selection, compose_instruction, subject_conditions, direction_swap, url_paths, index_images)
}

_MENTIONS = "regexp_extract_all({}, '\\bSubject\\s+(\\d+)\\b', 1)"
_WANT = "list_transform(range(1, greatest(len(subjects), 1) + 1), lambda x: x::VARCHAR)"
_TXT = """txt AS (SELECT sample_id, subjects,
    CASE k WHEN 1 THEN final_desc || '.' WHEN 2 THEN replace(final_desc, 'Identify ', 'Find ') ELSE final_desc END AS d,
    CASE k WHEN 3 THEN final_change || '!' WHEN 4 THEN replace(final_change, 'Subject 1', 'Subject 3') ELSE final_change END AS ch
    FROM (SELECT *, right(sample_id, 2)::INT % 7 AS k FROM smp))"""


def _join(x: str) -> str:
    return f"array_to_string({x}, ',')"


_CODES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
_TEXT_CODES = _CODES.format(
    f"""CASE WHEN NOT starts_with(ch, '{t.CHANGE_PREFIX}') THEN 'change_prefix' END, CASE WHEN regexp_matches(ch, '[.;:!?]$') THEN 'change_closing' END,
    CASE WHEN list_sort(list_distinct({_MENTIONS.format('ch')})) <> {_WANT} THEN 'change_subjects' END, CASE WHEN NOT starts_with(d, 'Identify ') THEN 'desc_prefix' END,
    CASE WHEN regexp_matches(d, '[.;:!?]$') THEN 'desc_closing' END, CASE WHEN {_MENTIONS.format('d')} <> {_WANT} THEN 'desc_subjects' END,
    CASE WHEN regexp_matches(d || ch, '[\\r\\n]') THEN 'several_lines' END"""
)
# the text without its beginning, its mentions' numbers and the words around them; then each mention's name and the words after it
_MARK = "(?:(?:the\\s+)?members\\s+of\\s+)?\\bSubject\\s+(\\d+)\\b"
_AUX = "after"
for _many, _one in t.AUXILIARIES.items():
    _AUX = f"CASE WHEN regexp_matches(after, '^ {_many}\\b') THEN ' {_one}' || substr(after, {len(_many) + 2}) ELSE {_AUX} END"
_COND = f"""parts AS (SELECT *, regexp_extract_all(x, '{_MARK}', 1) AS numbers, string_split_regex(x, '{_MARK}') AS words FROM (
    SELECT *, trim(CASE WHEN regexp_matches(lower(final_change), '^{t.CHANGE_PREFIX.strip()}\\s') THEN substr(final_change, {len(t.CHANGE_PREFIX)}) ELSE final_change END) AS x FROM one)),
cond AS (SELECT * EXCLUDE (numbers, words, x), words[1] || array_to_string(list_transform(range(1, len(numbers) + 1), lambda i:
    CASE WHEN numbers[i]::INT = subject_id THEN 'the reference person' ELSE 'the other referenced person (Subject ' || numbers[i] || ')' END
    || {_AUX.replace('after', 'words[i + 1]')}), '') AS condition FROM parts)"""
_PHRASES = ", ".join(f"'{x}'" for x in t.SIDE_PHRASES)

ORACLE = {
    "subject_mentions": with_cte("smp") + f"SELECT sample_id, {_join(_MENTIONS.format('final_desc'))} AS in_desc, {_join(_MENTIONS.format('final_change'))} AS in_change FROM smp",
    "text_issues": with_cte("smp", more=_TXT) + f"SELECT * FROM (SELECT sample_id, array_to_string(list_sort(string_split({_TEXT_CODES}, ',')), ',') AS issues FROM txt) WHERE issues <> ''",
    "parse_selection": with_cte("smp", more="""parts AS (SELECT sample_id, unnest(string_split(regexp_replace(regexp_replace(final_desc, '^Identify ', ''),
        '\\s+and\\s+Subject\\s+(\\d+)\\s+as\\s+', '|Subject \\1 as ', 'g'), '|')) AS p FROM smp)""")
    + "SELECT sample_id, nullif(regexp_extract(p, '^Subject (\\d+) as ', 1), '')::INT AS subject_id, trim(regexp_replace(p, '^Subject \\d+ as ', '')) AS description FROM parts",
    "compose_instruction": with_cte("smp") + "SELECT sample_id, final_desc || '; ' || final_change || '.' AS instruction FROM smp",
    "subject_conditions": with_cte("smp", more="one AS (SELECT DISTINCT sample_id, final_change, unnest(subjects).subject_id AS subject_id FROM smp)")
    + f", {_COND} SELECT sample_id, subject_id, condition FROM cond",
    "direction_swap": with_cte("smp", more="ch AS (SELECT sample_id, regexp_replace(final_change, 'stands (left|right) of', 'is standing to the \\1 of', 'g') AS x FROM smp)")
    + f""", m AS (SELECT sample_id, x, regexp_extract_all(x, '(?i)\\bSubject \\d+\\b') AS f, string_split_regex(x, '(?i)\\bSubject \\d+\\b') AS w FROM ch),
        r AS (SELECT *, list_filter(range(2, len(f) + 1), lambda i: lower(w[i]) IN ({_PHRASES})) AS hits FROM m),
        one AS (SELECT *, hits[1] AS h, f[hits[1] - 1] || w[hits[1]] || f[hits[1]] AS said FROM r WHERE len(hits) = 1 AND lower(f[hits[1] - 1]) <> lower(f[hits[1]]))
        SELECT sample_id, replace(x, said, f[h - 1] || CASE WHEN contains(lower(w[h]), 'left') THEN regexp_replace(w[h], '(?i)left of $', 'right of ') ELSE regexp_replace(w[h], '(?i)right of $', 'left of ') END || f[h]) AS swapped FROM one""",
    "url_paths": "SELECT DISTINCT image_id, path, CASE WHEN right(image_id, 2)::INT % 5 = 3 THEN NULL ELSE path END AS safe FROM images WHERE path IS NOT NULL",
    "index_images": with_cte("box") + "SELECT image_id, count(DISTINCT identity_id) AS identities, count(*) AS row_count FROM box WHERE identity_id IS NOT NULL GROUP BY image_id",
}
