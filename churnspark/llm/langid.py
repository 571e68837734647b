"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of
its labelled texts.  A text is compressed, block by block, with every dictionary;
the language that makes it smallest is predicted.  Where the second language makes
it hardly larger, the prediction is marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.llm.common import settle, texts

UNDETERMINED = "und"
#: Bytes that are compressed at once: short, so that a text's own repeats do not hide the dictionary.
BLOCK = 4096
#: Languages whose counts are broadcast at most.
MOST_BROADCAST = 10_000


def sample(labelled: DataFrame, per_language: int, piece: int) -> dict[str, tuple[int, bytes]]:
    """language -> (its number of labelled rows, dictionary content): ``per_language`` pieces of ``piece`` bytes at most.

    ``labelled`` has id, text, lang.  The rows with the smallest hashes are taken;
    a first cut by hash leaves few of a large language's rows to be ranked.
    """
    counts = settle(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if counts.count() <= MOST_BROADCAST:
        counts = F.broadcast(counts)
    unit = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    few = (labelled.join(counts, "lang").withColumn("u", unit).filter(F.col("u") * F.col("n") <= 4 * per_language)
           .select("lang", "n", "u", "id", F.lower("text").alias("text")))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id"))).filter(F.col("r") <= per_language)
    # anywhere in the text: many texts of a source may open alike
    start = F.pmod(F.xxhash64("id", F.lit("piece")), F.greatest(F.octet_length("text") - piece + 1, F.lit(1))).cast("int") + 1
    rows = ranked.select("lang", "n", "r", F.encode("text", "utf-8").substr(start, F.lit(piece)).alias("part")).collect()  # bounded by the two parameters
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], [r["n"], []])[1].append(bytes(r["part"]))
    return {lang: (n, b"\n".join(parts)) for lang, (n, parts) in out.items()}


def compressors(model: dict[str, tuple[int, bytes]]):
    """(language, compressor) with the most frequent language first: ties go to it."""
    import zstandard as z
    out = []
    for lang, (_, content) in sorted(model.items(), key=lambda x: (-x[1][0], x[0])):
        dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters.from_level(
            3, dict_size=len(content), source_size=BLOCK, min_match=3, strategy=z.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(content) >= 8:
            dictionary.precompute_compress(compression_params=how)
        out.append((lang, z.ZstdCompressor(dict_data=dictionary, compression_params=how)))
    return out


def identify(docs: DataFrame, labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             per_language: int = 512, piece: int = 200, margin: float = 0.01) -> DataFrame:
    """Every column of ``docs``, with lang_pred, score (0 to 1) and accepted; columns of these names are replaced.

    Learns from the rows of ``labelled`` with a text and a language.  score is the
    share by which the best language's size is below the second's (1 if there is
    only one language); accepted is false where it is under ``margin``.  A text that
    is null or has no letter gets lang_pred "und", score 0 and is not accepted; so
    does every text if nothing is labelled.  Ties go to the language with more
    labelled rows, then by name.  The model holds per_language * piece bytes for
    each language.
    """
    import pyarrow as pa
    learn = (labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
             .filter(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    model = docs.sparkSession.sparkContext.broadcast(sample(learn, per_language, piece))
    names = ("lang_pred", "score", "accepted")
    rows = docs.select(*[c for c in docs.columns if c not in names])
    keep = rows.columns
    at = keep.index(text)

    def has_letter(t: bytes) -> bool:
        return any(map(str.isalpha, t.decode("utf-8", "replace")))

    def run(batches: Iterator):
        tools = compressors(model.value)
        for batch in batches:
            preds, scores = [], []
            for t in texts(batch.column(at)):
                if not tools or t is None or not has_letter(t[:256]) and not has_letter(t):
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                t = t.decode("utf-8", "replace").lower().encode()
                blocks = [t[i : i + BLOCK] for i in range(0, len(t), BLOCK)]
                sizes = [sum(len(tool.compress(b)) for b in blocks) for _, tool in tools]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=None)
                preds.append(tools[best][0])
                scores.append(1.0 if second is None else 1.0 - sizes[best] / second)
            accepted = [p != UNDETERMINED and s >= margin for p, s in zip(preds, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                                             [*keep, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return rows.mapInArrow(run, schema)
