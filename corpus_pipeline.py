"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept.  ``run`` writes every stage's result
as Parquet in the shared folder and reads it again for the next, so that a lost
executor never sends the work back further than one stage; a result that the next
stage has used up is removed.

Columns beyond those of ``documents`` come through the first four stages as they are,
whatever their names; a stage never reads them.  An empty table gives an empty result
in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm.common import own_name, read_table, remove_folder, row_key, without
from churnspark.llm.linededup import dedup_lines
from churnspark.llm.mixing import mix
from churnspark.llm.neardup import near_duplicates
from churnspark.llm.packing import pack
from churnspark.llm.quality import apply_rules
from churnspark.llm.queries import MIX_WEIGHTS, source_domain, tokenizer_file
from churnspark.session import ensure_checkpoint_dir

#: Share of the tokens that the mix takes; every document once at most.
MIX_SHARE = 0.9


#: Columns that the stages read or set; others are the user's.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame):
    """``docs`` with the user's columns in one struct, out of reach of the operators' names, and the way back."""
    extra = [c for c in docs.columns if c.lower() not in DOCUMENT]
    if not extra:
        return docs, lambda out: out.select(*docs.columns)
    held = own_name(docs, "other_columns")
    packed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra], F.struct(*[F.col(f"`{c}`") for c in extra]).alias(held))
    return packed, lambda out: out.select(*[F.col(f"`{held}`.`{c}`").alias(c) if c in extra else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or the certified rules reject.

    Null, empty and short texts fail the base rule and go.  A null id or language is a
    value like any other; rows that repeat an id and text stand or fall together.
    """
    docs, back = _apart(docs)
    verdicts = apply_rules(docs, read_table(spark, sf_dir, "labels"))
    keyed = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    return back(without(keyed, "row_key", verdicts.filter(~F.col("kept"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave a line that ten documents have only where it comes first; documents that lose every word go.

    Null, empty and wordless texts that lose nothing stay as they are.  Rows that repeat
    an id are one document in the count; ``n_chars`` becomes that of the text that is left.
    """
    docs, back = _apart(docs)
    out = dedup_lines(docs, min_docs=10, keep_first=True)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return back(out.filter(~empty).withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave the document with the smallest id of each group of near copies.

    Null, empty and wordless texts and rows with a null id are in no group and stay;
    rows that repeat an id stay or go together.
    """
    docs, back = _apart(docs)
    return back(without(docs, "doc_id", near_duplicates(docs).filter(~F.col("kept"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the share of all tokens that comes nearest to the target weights, each document once at most.

    Null sources and languages are leaves of their own.  Documents without tokens cost
    nothing and stay where their leaf is taken.  Equal ranks go by id and text.
    """
    docs, back = _apart(docs)
    return back(mix(docs, domain=source_domain(), weights=MIX_WEIGHTS, budget=MIX_SHARE, max_epochs=1, seed=7).filter("copies > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence.

    A null or empty text is the end token alone; rows that repeat an id are packed each.
    """
    return pack(docs, tokenizer_file())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("packing", packing)]

#: SQL cannot express the tokenizer and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, used = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if used:
                remove_folder(spark, used)
            used = f"{folder}/{name}"
    return docs
