"""Exact de-duplication by distributed MSD radix partitioning.

Texts are split by successive bytes. A digit is a run of bytes: the first is
narrow, later ones grow, as only texts that agree so far are still read. After
each digit, groups of one text are done, and so are groups that have ended;
the rest goes on. Equality is that of the bytes themselves: no digest is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

FIRST_BYTES = 64
GROWTH = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Rows (doc_id, keep_id, copies): one for each row of docs.

    keep_id is the least id among the rows with the same text and copies their
    number. Null texts equal each other and differ from the empty text. Rows
    that repeat an id each count; a null id is never kept if another is there
    (keep_id is null only if all ids of the group are). An empty table gives no
    rows; very long texts take more rounds, of as much as is left of them; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return _groups(rows, ["id"], first_bytes, growth).select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "copies")


def _groups(rows: DataFrame, name: list[str], first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Rows (*name, keep, copies) of rows (*name, t): keep is the least name of the group, null ids last."""
    own = F.struct(*name)
    if name == ["id"]:  # min of numbers passes over nulls, and is summed by hash
        least = lambda: F.struct(F.min("id").alias("id"))
    else:
        least = lambda: F.min_by(own, F.struct(F.col("id").isNull(), *name))
    no_text = rows.where("t is null")
    done = [no_text.select(*name).crossJoin(F.broadcast(no_text.agg(least().alias("keep"), F.count("*").alias("copies"))))]
    todo = rows.where("t is not null").select(*name, F.lit(0).cast("long").alias("g"), F.encode("t", "UTF-8").alias("rest"))
    width, split = first_bytes, None
    while True:
        digit = F.substring("rest", 1, width)
        # Counted with a partial aggregate on the map side: a hot digit is one row of each task.
        many = (
            todo.groupBy("g", digit.alias("digit")).agg(F.count("*").alias("n"), least().alias("least")).where("n > 1")
            .select(F.col("g").alias("g0"), "digit", "n", "least", F.monotonically_increasing_id().alias("next"))
        )
        many = store.written(many, "radix-groups")
        # Unique keys on the build side; a hot digit on the other side is one that AQE can split.
        joined = todo.join(many.hint("shuffle_hash"), (F.col("g") == F.col("g0")) & (digit == F.col("digit")), "left")
        goes_on = F.col("n").isNotNull() & (F.octet_length("rest") >= width)
        split = store.written(
            joined.select(
                *name, F.when(F.col("n").isNull(), own).otherwise(F.col("least")).alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("copies"),
                F.when(goes_on, F.col("next")).alias("g"), F.when(goes_on, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
            ),
            "radix",
        )
        store.drop(many)
        done.append(split.where("g is null").select(*name, "keep", "copies"))
        todo = split.where("g is not null").select(*name, "g", "rest")
        if todo.isEmpty():
            break
        width *= growth
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row with a lesser id has.

    Of rows that repeat both id and text one stays; a group in which every id
    is null keeps one row. Rows with null text are kept, as nothing is known of
    them; an empty text is one as any other. Rows whose id is null or repeated
    are numbered, in a table of their own, and told apart by that. Other
    columns, of whatever name, are kept as they are.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).isNotNull().alias("some"))
    unsure = ids.groupBy("id").agg(F.count("*").alias("n"), F.max("some").alias("some")).where("some and (n > 1 or id is null)").select(F.col("id").alias("__unsure"))
    unsure = store.written(unsure, "unsure")
    text = F.col(text_col).cast("string").alias("t")
    if unsure.isEmpty():
        rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text)
        lost = _groups(rows, ["id"]).where("copies > 1 and id <> keep.id")
        return store.without(docs, lost.select("id"), id_col)
    few, same = store.small(unsure), docs[id_col].cast("long").eqNullSafe(F.col("__unsure"))
    numbered = store.written(docs.join(few, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    single = docs.join(few, same, "left_anti")
    named = lambda x, row: x.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), row.alias("row"), text)
    rows = named(single, F.lit(-1).cast("long")).unionByName(named(numbered, F.col("__row")))
    groups = _groups(rows, ["id", "row"]).where("copies > 1 and not (id <=> keep.id and row = keep.row)").select("id", "row")
    lost = store.written(groups, "copies")
    gone = store.small(lost.where("row >= 0").select(F.col("row").alias("__gone")))
    kept = numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(docs.columns)
    return store.without(single, lost.where("row < 0").select("id"), id_col).select(docs.columns).unionByName(kept)
