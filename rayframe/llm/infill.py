"""Fill-in-the-middle: texts cut into prefix, middle and suffix by hashes, rearranged under sentinels, and restored.

Built-in Spark functions only, one pass without a shuffle: the same at every size, and no text meets another.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, so that they join to the whole text. A text that is
empty or holds a sentinel stays plain. Sentinels begin with ``<`` and end with ``>``, so none can arise across a border,
and the output splits at exactly the three that were put in.

Defined results: a null text counts as empty, a null id as empty digits. Repeated rows give equal rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
P, S, M = "<P>", "<S>", "<M>"


def arrange(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix, output of every document.

    ``rate``: of 100 texts so many are cut. ``spm``: of 100 of these so many have the suffix first. Parts of plain texts are null.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text"), F.lit(""))
    draws = [F.conv(F.substring("digits", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", text.alias("text"), digits.alias("digits"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)).alias("units"), *draws)
    a, b = (F.col(h) % (F.size("units") + 1) for h in ("h1", "h2"))
    held = F.col("text").contains(P) | F.col("text").contains(S) | F.col("text").contains(M)
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", F.least(a, b).cast("int").alias("cut"), F.greatest(a, b).cast("int").alias("end"), form.alias("form"))

    def part(start: Column, length: Column, name: str) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), "")).alias(name)

    rows = rows.select(
        "doc_id", "text", F.size("units").cast("long").alias("n"), "form", part(F.lit(1), F.col("cut"), "prefix"),
        part(F.col("cut") + 1, F.col("end") - F.col("cut"), "middle"), part(F.col("end") + 1, F.size("units") - F.col("end"), "suffix"),
    )
    psm = F.concat(F.lit(P), "prefix", F.lit(S), "suffix", F.lit(M), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(F.concat(F.lit(S), "suffix", F.lit(P), "prefix", F.lit(M), "middle"))
    return rows.withColumn("output", output)


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: what stands after each sentinel, in the order prefix, middle, suffix."""
    parts = F.split(output, f"{P}|{S}|{M}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def infill_digests(docs: DataFrame) -> DataFrame:
    """Of every document: doc_id, n, form, sizes of prefix and middle in code points, digests of output and restored text."""
    rows = arrange(docs)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{UNITS}') AS units,
  [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT doc_id, text, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
