"""Text normalisers of speech corpora, as Catalyst expressions, and a character vocabulary."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens and marks that the far-field meeting normaliser drops.
MEETING_TOKENS = ["<sil>", "<%>", "<->", "<$>", "<#>", "<_>", "<space>"]
MEETING_MARKS = "`&,，丶。、？"
# Full-width letters and what they stand for.
WIDE_LETTERS = ("Ａａｂｃｋｔ", "AABCKT")


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def upper_ss(c: Column) -> Column:
    return F.upper(c)


def ami(c: Column, style: str = "upper") -> Column:
    if style == "none":
        return c
    up = F.upper(c)
    if style == "upper":
        return up
    words = F.trim(_replace(up, r"[^A-Z0-9']+", " "))
    joined = _replace(_replace(words, "MM HMM", "MM-HMM"), "UH HUH", "UH-HUH")
    return F.trim(_replace(joined, r"\bO[ _]K\b", "OK"))


def alimeeting(c: Column, style: str = "m2met") -> Column:
    if style == "none":
        return c
    out = reduce(lambda a, token: F.replace(a, F.lit(token), F.lit("")), MEETING_TOKENS, c)
    out = F.translate(out, "`&,", "")
    out = F.when(out.rlike("[a-zA-Z]"), F.upper(out)).otherwise(out)
    return F.translate(out, WIDE_LETTERS[0] + "，丶。、？", WIDE_LETTERS[1])


def chime6(c: Column, style: str = "upper") -> Column:
    if style == "none":
        return c
    if style == "upper":
        return F.upper(c)
    low = _replace(_replace(F.lower(c), r"[.?,:;!]", ""), r"\s+", " ")
    low = _replace(_replace(low, r"\[inaudible[- 0-9]*\]", "[inaudible]"), " - ", " ")
    return F.when(c.contains("[redacted]"), "").otherwise(_replace(low, "mm-", "mm"))


def tedlium(c: Column, style: str = "upper") -> Column:
    if style == "none":
        return c
    if style == "upper":
        return F.upper(c)
    out = _replace(_replace(c, r"\[[^\]]+\]", ""), "<unk>", "")
    return F.trim(_replace(_replace(out, r"(\w+) '(\w+)", "$1'$2"), r"' (\w+)", "'$1"))


NORMALIZERS = {"ami": ami, "alimeeting": alimeeting, "chime6": chime6, "tedlium": tedlium}


def vocabulary(df: DataFrame, text: str, specials: tuple[str, ...] = ("<pad>", "<unk>", "<bos>", "<eos>")) -> DataFrame:
    """(token, token_id): the specials, then every character of the corpus in code point order.

    Characters are counted per partition first; the result is bounded by Unicode.
    """
    from pyspark.sql import Window

    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("token")).where("token <> ''").distinct()
    ranked = chars.select("token", (F.row_number().over(Window.orderBy("token")) + len(specials) - 1).cast("long").alias("token_id"))
    head = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, token_id long")
    return head.unionByName(ranked)


def merged_with_delimiter(values: Column, prefix: str = "cat", delimiter: str = "#", first_only: bool = False) -> Column:
    """None for no value, the value for one, else prefix and values joined; or only the first."""
    v = F.filter(values, lambda x: x.isNotNull())
    first = F.try_element_at(v, F.lit(1))
    if first_only:
        return first
    return F.when(F.size(v) <= 1, first).otherwise(F.concat_ws(delimiter, F.lit(prefix), F.array_join(v, delimiter)))


def encoded_characters(df: DataFrame, text: str, vocab: DataFrame, key: str = "id", bos: bool = True, eos: bool = True) -> DataFrame:
    """(key, ids): character ids of each text between the marks of its begin and end; characters outside the vocabulary are <unk>.

    The vocabulary, bounded by Unicode, goes to all tasks as one array with an id at each code point, so no
    text is taken apart into rows, and repeated and null keys give a row for each of their texts. A batch of texts
    is looked up at once in Python: a built-in lookup would copy the array into each row.
    """
    known = vocab.select("token", F.col("token_id").cast("long").alias("token_id"), F.when(F.char_length("token") == 1, F.ascii("token")).alias("point")).toArrow()
    special = {t: known["token_id"][i].as_py() for i, t in enumerate(known["token"].to_pylist()) if t in ("<pad>", "<unk>", "<bos>", "<eos>")}
    single = known.filter(known["point"].is_valid())
    points = single["point"].to_numpy()
    by_point = np.full((int(points.max()) if len(points) else 0) + 2, special["<unk>"], dtype=np.int64)  # the last for all beyond
    by_point[points] = single["token_id"].to_numpy()

    def looked_up(texts: pa.Array) -> pa.Array:
        strings = texts.to_pylist()
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([0, *map(len, strings)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(by_point[np.minimum(codes, len(by_point) - 1)], pa.int64()))

    looked_up.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # as types, not as their names
    ids = F.arrow_udf(looked_up, "array<long>")
    one = lambda name, on: F.array(F.lit(special[name]).cast("long")) if on else F.expr("cast(array() as array<bigint>)")
    return df.where(F.col(text).isNotNull()).select(key, F.concat(one("<bos>", bos), ids(text), one("<eos>", eos)).alias("ids"))
