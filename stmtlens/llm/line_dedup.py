"""Removal of cross-site boilerplate lines by their distinct-site spread.

Every line is hashed; a HyperLogLog sketch of the sites per line hash merges by aggregation, so
a line on a third of all pages costs a sketch per task, not its rows.  Where the estimate is
near the threshold, the sites are counted exactly; elsewhere the sketch decides.  A line spread
over enough sites is boilerplate and goes from every document but its first (that of the least
key), so no text is lost altogether.  A passage, a line of more than ``PASSAGE_WORDS`` words, also
goes when two documents of different texts hold it, be they of one site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.llm.common import SPACES, parts, ship, table, written
from stmtlens.llm.quality import with_length

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 3
#: A line of more words is a passage.
PASSAGE_WORDS = 50
#: Bits of the sketches: a standard error of 1.04 / sqrt(2 ** 12) = 1.6 percent.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly (six standard errors).
NEAR = 0.1


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(k, d, pos, h, s, passage): key, text digest, position, line hash, site and whether it has
    more than ``PASSAGE_WORDS`` words, of every line that isn't blank."""
    lines = docs.select(
        F.col(key).alias("k"), _digest(text).alias("d"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("s"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    # Fewer characters can't hold so many words, so most lines are not split.
    words = F.split(F.btrim("line", F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    passage = (F.length("line") > 2 * PASSAGE_WORDS) & (F.size(words) > PASSAGE_WORDS)
    return lines.withColumn("line", F.trim("line")).filter("line <> ''").select(
        "k", "d", "pos", F.xxhash64("line").alias("h"), "s", passage.alias("passage")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, passages: bool = True) -> DataFrame:
    """(h, first): the line hashes on ``min_sites`` sites or more, and the least key that holds each.

    With ``passages``, also those of passages that documents of different texts hold.
    """
    sketched = lines.groupBy("h").agg(
        F.hll_sketch_agg("s", LG_K).alias("sketch"), F.min("k").alias("first"),
        # Two different digests are exact without a sketch.
        (F.first("passage") & (F.min("d") < F.max("d")) & F.lit(passages)).alias("passage"),
    )
    margin = min_sites * NEAR + 1
    likely = written(
        sketched.select("h", "first", "passage", F.hll_sketch_estimate("sketch").alias("sites")).filter(
            F.col("passage") | (F.col("sites") >= min_sites - margin)
        ),
        "spread",
    )
    # Beyond the margin the sketch decides; within it the sites are counted.
    near = ~F.col("passage") & (F.col("sites") <= min_sites + margin)
    counted = (
        lines.join(likely.filter(near).select("h"), "h", "left_semi")
        .groupBy("h").agg(F.count_distinct("s").alias("exact"))
    )
    decided = likely.join(counted, "h", "left").filter(F.col("passage") | (F.coalesce("exact", "sites") >= min_sites))
    return written(decided.select("h", "first"), "boilerplate")


def remove_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source",
    passages: bool = True,
) -> DataFrame:
    """``docs`` without its boilerplate lines, and ``_llm_removed``, the number of lines taken.

    Lines are compared without the spaces around them; blank lines stay and are never counted.  A
    null site is one site without a name; a null text stays null; a null key is never the first
    holder unless no other is.  Repeated rows are treated alike (a line is kept in all rows of its
    first key).  Documents alike in text are one to the rule of passages, so that copies within a
    site stay whole.  All columns stay; an empty table gives an empty result.  Line hashes have 64 bits.
    """
    import pyarrow as pa

    lines = written(line_rows(docs, key, text, site), "lines")
    spread = spread_lines(lines, min_sites, passages)
    hit = lines.join(spread, "h").filter(~F.col("k").eqNullSafe(F.col("first")))
    taken = hit.groupBy(F.col("k").alias("_llm_k"), F.col("d").alias("_llm_d")).agg(F.collect_set("pos").alias("_llm_taken"))
    marks = written(taken, "marks")
    marked = docs.withColumn("_llm_digest", _digest(text))
    # A merge at every size: what could be broadcast grows with the documents.
    joined = marked.join(
        marks.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col("_llm_k")) & (F.col("_llm_digest") == F.col("_llm_d")), "left"
    ).select(*(F.col(f"`{c}`") for c in docs.columns), "_llm_taken")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in parts(batches):
            fresh, counts = [], []
            for value, taken in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if taken:
                    gone = set(taken)
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone)
                fresh.append(value)
                counts.append(len(taken) if taken else 0)
            columns = [*batch.columns[:-1], pa.array(counts, type=pa.int64())]
            columns[at] = pa.array(fresh, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_llm_removed"])

    ship(docs.sparkSession)
    out = docs.schema.jsonValue()
    out["fields"].append({"name": "_llm_removed", "type": "long", "nullable": True, "metadata": {}})
    return with_length(joined.mapInArrow(run, type(docs.schema).fromJson(out)), text)


def clean_documents(docs: DataFrame, **names) -> DataFrame:
    """``docs`` without boilerplate lines; documents that hold nothing but those go."""
    cleaned = remove_spread_lines(docs, **names)
    text = names.get("text", "text")
    emptied = (F.col("_llm_removed") > 0) & (F.trim(F.replace(text, F.lit("\n"))) == "")
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).drop("_llm_removed")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    # The query's SQL counts sites alone.
    return remove_spread_lines(docs, passages=False).select(
        "doc_id", F.col("_llm_removed").alias("n_removed"),
        F.length("text").cast("bigint").alias("n_chars_left"), F.md5("text").alias("left_md5"),
    )


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT trim(line) AS line, min(doc_id) AS first FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.line, l.pos, s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first AS gone
  FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line),
left_over AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, length(l.text) AS n_chars_left, md5(l.text) AS left_md5
FROM documents d LEFT JOIN left_over l USING (doc_id)
"""
