"""Records that differ only in dress, collapsed by progressive partition refinement.

A class of possible copies is first cut by cheap invariants (source, stripped length, a letter histogram), which no
change of white space, case, punctuation or field order can alter.  Only rows in classes with several members get the
costlier keys: the stripped text, and for lists of ``label: value`` fields the sorted fields.  Every step groups by a
hash of bounded size with partial aggregation, so a class may hold any share of the rows.

Defined results: null texts and texts with fewer than ``MIN_CHARS`` letters and digits belong to no group; a null
source equals only a null source; rows with equal ids count as copies; columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.runtime import written

MIN_CHARS = 20
MIN_FIELDS = 5
_FIELD = r"^[^:]{1,60}:.*[\p{L}\p{N}].*$"
_LETTERS = "aeinorst"


def stripped(c: Column) -> Column:
    """Letters with their marks and digits only, case folded."""
    folded = F.replace(F.translate(F.lower(F.upper(F.lower(c))), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(folded, "[\\x{FE00}-\\x{FE0F}\\x{20D0}-\\x{20FF}]", ""), r"[^\p{L}\p{M}\p{N}]+\p{M}*|^\p{M}+", "")


def field_key(c: Column) -> Column:
    """Sorted stripped fields of a text that is a list of ``label: value`` fields, else null."""
    pieces = F.filter(F.split(c, r"[\n\r|;]+"), lambda x: stripped(x) != "")
    is_list = (F.size(pieces) >= MIN_FIELDS) & F.forall(pieces, lambda x: x.rlike(_FIELD) & (stripped(F.substring_index(x, ":", 1)) != ""))
    return F.when(is_list, F.array_join(F.array_sort(F.transform(pieces, stripped)), "\x01"))


def copy_groups(rows: DataFrame, id_col: str = "landing_id", text_col: str = "raw_text", source_col: str = "source") -> DataFrame:
    """One row (record_id, first_id, n_copies) per member of a group with at least two records."""
    base = rows.select(F.col(id_col).alias("record_id"), F.coalesce(stripped(F.col(source_col)), F.lit("null\x01")).alias("s"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    # step 1: length and histogram of the stripped text, one small hash a row
    cheap = base.select("*", F.inline(F.array(F.struct(stripped(F.col("t")).alias("p")))))
    counts = [F.length("p") - F.length(F.translate("p", ch, "")) for ch in _LETTERS]
    cheap = cheap.where(F.length(F.regexp_replace("p", r"\p{M}", "")) >= MIN_CHARS).select("record_id", "t", "s", "p", F.xxhash64("s", F.length("p"), *counts).alias("c1"))
    classes = cheap.groupBy("c1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1")
    survivors = cheap.join(classes, "c1", "left_semi")
    # step 2: exact keys, as digests, only inside classes with several members
    keyed = survivors.select("record_id", "s", F.sha2("p", 256).alias("plain"), F.sha2(field_key(F.col("t")), 256).alias("fields"))
    keyed = written(keyed, "copies")
    # a text without separators can equal a list in one field order: it joins that list's group
    lists = keyed.where(F.col("fields").isNotNull()).groupBy("s", "plain").agg(F.min("fields").alias("as_fields"))
    keyed = keyed.join(lists, ["s", "plain"], "left").select("record_id", "s", F.coalesce("fields", "as_fields", "plain").alias("k"))
    groups = keyed.groupBy("s", "k").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return keyed.join(groups, ["s", "k"]).select("record_id", "first_id", "n_copies")


def one_per_group(rows: DataFrame, id_col: str = "landing_id", text_col: str = "raw_text", source_col: str = "source") -> DataFrame:
    """One record each: the smallest id of every group, or the record itself, with its number of copies."""
    members = copy_groups(rows, id_col, text_col, source_col)
    firsts = members.where("record_id = first_id").select(F.col("record_id").alias(id_col), "n_copies").dropDuplicates([id_col])
    others = members.where("record_id <> first_id").select(F.col("record_id").alias(id_col))
    return rows.join(others, id_col, "left_anti").join(firsts, id_col, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))
