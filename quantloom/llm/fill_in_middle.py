"""Fill-in-middle transformation of documents by relational units.

A text is cut into units, the matches of a pattern (lines by default). The units of all documents are rows of
(document, ordinal, length), exploded with their positions; a window sums lengths up to every unit. A document asks for
two cuts, each after a number of units that is hashed from its id; requests meet running sums by document and
ordinal, and an aggregate turns them into the two offsets of a document. Only then is the text looked at again:
three substrings, put in the order of the document's form.

What is exploded, summed and joined are lengths, not texts: rows with one id and text are one document there, pre-aggregated
before they are moved. All of it is dealt by document, so that sums, requests and offsets share one shuffle; texts are moved
once, to meet their offsets, in a join whose hot keys Spark may split.

Defined cases: null text counts as empty; an empty text has no units and is plain; so is a text that holds a marker, since it could
not be rebuilt; a null id is hashed like an empty one; repeated rows give repeated results; an id with several texts
is a document for each; what the pattern does not match is left out of units, so a pattern should cover the text;
an empty table gives no rows; other columns are not looked at by `transform` and carried by `fim_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stored

LINE = r"[^\n]*\n|[^\n]+"
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Shares of documents, in percent: that are transformed at all, and of those in the form suffix, prefix, middle.
FIM_PERCENT, SPM_PERCENT = 100, 50
SEED = "7"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id_: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with what tells documents apart: __id (the id as text) and __hash (of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__hash": F.xxhash64(text)})


def offsets(docs: DataFrame, unit: str = LINE, seed: str = SEED) -> DataFrame:
    """__id, __hash, n (units), first, second (code points before either cut) of every document."""
    lengths = F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(unit), F.lit(0)), F.length)
    sizes = keyed(docs).select("__id", "__hash", lengths.alias("lengths")).groupBy("__id", "__hash").agg(F.first("lengths").alias("lengths"))
    units = sizes.select("__id", "__hash", F.posexplode("lengths").alias("place", "length"))
    upto = F.sum("length").over(Window.partitionBy("__id", "__hash").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    sums = units.select("__id", "__hash", (F.col("place") + 1).cast("long").alias("ordinal"), upto.alias("upto"))
    h = draws(F.col("__id"), seed)
    n = F.size("lengths").cast("long")
    asked = sizes.select("__id", "__hash", n.alias("n"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("a"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("b"))
    # A request after no unit meets none, and its offset is 0.
    same = (asked["__id"] == sums["__id"]) & (asked["__hash"] == sums["__hash"])
    met = asked.join(sums, same & ((F.col("ordinal") == F.col("a")) | (F.col("ordinal") == F.col("b"))), "left")
    at = {name: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("upto"))), F.lit(0)).cast("int").alias(name) for name, cut in (("first", "a"), ("second", "b"))}
    return met.groupBy(asked["__id"], asked["__hash"]).agg(F.max("n").alias("n"), *at.values())


def rebuilt(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from output and form alone.

    No part of a text that is not plain holds a marker, and no marker can begin within a part and end in the next marker.
    """
    p, s, m = (F.lit(x) for x in markers)
    at_p, at_s, at_m = (F.instr(output, x) for x in markers)
    size_p, size_s, size_m = (len(x) for x in markers)

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, end - start)

    end = F.length(output) + 1
    psm = F.concat(between(at_p + size_p, at_s), between(at_m + size_m, end), between(at_s + size_s, at_m))
    spm = F.concat(between(at_p + size_p, at_m), between(at_m + size_m, end), between(at_s + size_s, at_p))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def _transformed(docs: DataFrame, unit: str, fim_percent: int, spm_percent: int, markers: tuple[str, str, str], seed: str) -> DataFrame:
    """docs with __text, __n, __form, __first, __second, __output."""
    cuts = stored(offsets(docs, unit, seed), "fim-offsets")
    joined = keyed(docs).join(cuts.select("__id", "__hash", F.col("n").alias("__n"), F.col("first").alias("__first"), F.col("second").alias("__second")), ["__id", "__hash"])
    text, h = F.coalesce(F.col("text"), F.lit("")), draws(F.col("__id"), seed)
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when((text == "") | marked | (h[2] % 100 >= fim_percent), PLAIN).when(h[3] % 100 < spm_percent, SPM).otherwise(PSM)
    formed = joined.withColumns({"__text": text, "__form": form})
    first, second = F.col("__first"), F.col("__second")
    parts = {
        "__prefix": F.substring("__text", F.lit(1), first),
        "__middle": F.substring("__text", first + 1, second - first),
        "__suffix": F.substring("__text", second + 1, F.length("__text")),
    }
    p, s, m = (F.lit(x) for x in markers)
    prefix, middle, suffix = (F.col(c) for c in parts)
    output = F.when(F.col("__form") == PLAIN, F.col("__text")).when(F.col("__form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return formed.withColumns(parts).withColumn("__output", output)


def transform(
    docs: DataFrame, unit: str = LINE, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS, seed: str = SEED
) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars (null if plain), output, a row for each of docs."""
    done = _transformed(docs, unit, fim_percent, spm_percent, markers, seed)
    shaped = F.col("__form") != PLAIN
    return done.select(
        "doc_id", "text", F.col("__n").alias("n"), F.col("__form").alias("form"),
        F.when(shaped, F.col("__first").cast("long")).alias("prefix_chars"), F.when(shaped, (F.col("__second") - F.col("__first")).cast("long")).alias("middle_chars"),
        F.col("__output").alias("output"),
    )


def fim_documents(
    docs: DataFrame, unit: str = LINE, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS, seed: str = SEED
) -> DataFrame:
    """The documents, with all their columns, and the transformed text for their text; null stays null."""
    done = _transformed(docs, unit, fim_percent, spm_percent, markers, seed)
    return done.select(*[F.when(F.col("text").isNotNull(), F.col("__output")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    found = transform(docs)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+'), lambda x: length(x)) AS sizes
  FROM documents),
c AS (
  SELECT *, CAST(len(sizes) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(sizes) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(sizes) + 1) AS y,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS z, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS q FROM d),
o AS (
  SELECT doc_id, t, n, CAST(coalesce(list_sum(sizes[1:least(x, y)]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[1:greatest(x, y)]), 0) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 100 THEN 'plain' WHEN q < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || t[1:a] || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
