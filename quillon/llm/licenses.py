"""Licence scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import DIGESTS, LICENSES

#: Spellings that mean the same, after lower case; then what is cut, pattern and replacement.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright-holder", "copyright holder"), ("copyright owner", "copyright holder"), ("https://", "http://"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("utilisation", "utilization"), ("recognise", "recognize"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("whilst", "while"),
)
CUTS = ((r"(^|\n)[ \t]*((copyright( ?\(c\)| ?©)?|\(c\)|©) ?([0-9{\[<]|by )|all rights reserved)[^\n]*", "\n"), (r"[^\p{L}\p{N}]+", " "))
#: Known texts up to which their digests (some 100 bytes each) are broadcast; a longer list is joined by shuffling.
MOST_BROADCAST = 50_000


def canonical(text: Column) -> Column:
    """Lower case, equal spellings, no copyright lines, letters and digits with one space between them."""
    text = F.lower(text)
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    for pattern, to in CUTS:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def forms(licenses: dict[str, str]) -> list[tuple[str, str]]:
    """name and text of each, and the text without its title where the first paragraph is a line that ends in License."""
    untitled = [(name, text.partition("\n\n")[2]) for name, text in licenses.items() if text.partition("\n")[0].endswith("License") and "\n\n" in text]
    return sorted([*licenses.items(), *untitled])


def known_digests(spark: SparkSession, licenses: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """digest, license: one row a known text, of the texts (name: text) and the digests (digest: name) given, the built-in ones without either."""
    if licenses is None and digests is None:
        licenses, digests = LICENSES, DIGESTS
    of_texts = spark.createDataFrame(forms(licenses or {}), "license string, known string").select(F.sha2(canonical(F.col("known")), 256).alias("digest"), "license")
    every = of_texts.unionByName(spark.createDataFrame(sorted((digests or {}).items()), "digest string, license string"))
    return every.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, digest, license, n_notices, notices.

    digest: SHA-256 of the whole text in its canonical form (a missing text is empty). license: the known text that has
    this digest, or null. notices: the known texts that whole lines are, sorted, with commas; n_notices counts such lines.
    A document is one row however often its doc_id is repeated in the table, an empty table gives none, and other columns
    are ignored. Known texts come as texts or as digests of canonical texts. Both lookups are hash joins of digests with their
    list, which is broadcast up to MOST_BROADCAST texts; only lines that are known are grouped by document.
    """
    known = known_digests(docs.sparkSession, licenses, digests)
    if len(licenses or {}) + len(digests or {}) <= MOST_BROADCAST:  # the built-in list is far below that
        known = F.broadcast(known)
    text = F.coalesce(F.col("text"), F.lit(""))
    of_text = F.xxhash64(text).alias("x")
    rows = docs.select("doc_id", of_text, F.sha2(canonical(text), 256).alias("digest"))
    rows = rows.groupBy("doc_id", "x", "digest").agg(F.count("*").alias("copies")).join(known, "digest", "left")
    lines = docs.select("doc_id", of_text, F.explode(F.split(text, "\n")).alias("line"))
    found = lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(known, "digest").groupBy(F.col("doc_id").alias("found_in"), F.col("x").alias("found_x"))
    found = found.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("license")).alias("names"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_in")) & (F.col("x") == F.col("found_x")), "left")
    out = out.select("doc_id", "digest", "license", F.coalesce((F.col("n") / F.col("copies")).cast("long"), F.lit(0)).alias("n_notices"), F.concat_ws(",", F.coalesce("names", F.array())).alias("notices"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.drop("col")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    x = f"lower({x})"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, to in CUTS:
        x = f"regexp_replace({x}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    return f"trim({x})"


def _oracle() -> str:
    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in forms(LICENSES))
    digests = ", ".join(f"('{d}', '{name}')" for d, name in sorted(DIGESTS.items()))
    return f"""
WITH known(license, t) AS (VALUES {values}), more(digest, license) AS (VALUES {digests}),
k AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_sql_canonical('t')}) AS digest, license FROM known UNION ALL SELECT digest, license FROM more) GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
m AS (SELECT l.doc_id, k.license FROM l JOIN k ON sha256({_sql_canonical('l')}) = k.digest),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM m GROUP BY 1)
SELECT d.doc_id, d.digest, k.license, coalesce(n.n, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)
"""


ORACLE = _oracle()
