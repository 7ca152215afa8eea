"""Documents as a table: upsert, partial update, lookup, deletion, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_of_each(batch: DataFrame, *, key: str = "_id", position: str = "pos") -> DataFrame:
    """Of the rows that share a key the last one by position."""
    last = Window.partitionBy(key).orderBy(F.desc(position))
    return batch.withColumn("nth_", F.row_number().over(last)).where("nth_ = 1").drop("nth_")


def with_ids(batch: DataFrame, token: str, *, key: str = "_id") -> DataFrame:
    """Rows without a key get one that depends on the row and on `token`, the batch's name, alone: run again they get it again.

    Equal rows are told apart by their number among their likes.
    """
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{x}`") for x in batch.columns if x not in (key, "pos")))), F.lit(token)) if set(batch.columns) - {key, "pos"} else F.xxhash64(F.lit(token))
    order = F.row_number().over(Window.partitionBy("row_").orderBy("pos" if "pos" in batch.columns else "row_"))
    bare = batch.where(F.col(key).isNull()).withColumn("row_", row).withColumn("nth_", order)
    named = bare.withColumn(key, F.sha2(F.concat_ws(":", F.lit(token), "row_", "nth_"), 256)).drop("row_", "nth_")
    return batch.where(F.col(key).isNotNull()).unionByName(named)


def validated(batch: DataFrame, rules: dict[str, Column], *, key: str = "_id") -> DataFrame:
    """(all columns, status, error): 200, or 400 with the name of the first rule that a row breaks; a bad row stops no other."""
    error = F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))
    return batch.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def upsert(old: DataFrame, new: DataFrame, *, key: str = "_id") -> DataFrame:
    """Whole rows of `new` in place of those of `old` with their key; columns that only one has are null in the other."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(docs: DataFrame, patches: DataFrame, *, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Documents with the fields that a patch has, and (key, status): 200, or 404 for keys that no document has.

    A null in a patch changes nothing.  Map fields change key by key.  Nothing is created.  Of patches that share a key the last
    value of each field counts, by `pos` if they have it (and the documents don't), else by their order.
    """
    kinds = {x.name: x.dataType for x in docs.schema}
    placed = "pos" in patches.columns and "pos" not in kinds
    fields = [x for x in patches.columns if x != key and not (placed and x == "pos")]
    if unknown := [x for x in fields if x not in kinds]:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    last = [F.max_by(F.col(f"`{x}`"), F.when(F.col(f"`{x}`").isNotNull(), F.col("at_"))).alias(f"new_{x}") for x in fields]
    by_key = patches.withColumn("at_", F.col("pos") if placed else F.monotonically_increasing_id()).groupBy(key)
    given = by_key.agg(*last) if last else by_key.agg(F.count("*").alias("n_")).drop("n_")

    def changed(x: str) -> Column:
        old, new = F.col(f"`{x}`"), F.col(f"new_{x}")
        if isinstance(kinds[x], T.MapType):
            both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
            return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both)
        return F.coalesce(new, old)

    updated = docs.join(given, key, "left").select(key, *(changed(x).alias(x) if x in fields else F.col(f"`{x}`") for x in docs.columns if x != key))
    status = given.select(key).join(docs.select(key, F.lit(200).alias("status")), key, "left").select(key, F.coalesce("status", F.lit(404)).alias("status"))
    return updated, status


def get_documents(docs: DataFrame, ids: DataFrame, *, key: str = "_id") -> DataFrame:
    """For each row of `ids` (pos, key) the document and `_found`."""
    return ids.join(docs.withColumn("_found", F.lit(True)), key, "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def delete_documents(docs: DataFrame, ids: DataFrame, *, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """The other documents, and (key, status): 200 also for keys that no document has."""
    return docs.join(ids.select(key), key, "left_anti"), ids.select(key, F.lit(200).alias("status"))


def responses(rows: DataFrame) -> DataFrame:
    """One row of counts of statuses by hundreds."""
    hundreds = F.floor(F.col("status") / 100)
    return rows.agg(*(F.count_if(hundreds == k).cast("long").alias(name) for k, name in ((2, "success"), (4, "failure"), (5, "error"))))


def index_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, and vectors over all fields (0 if there are none)."""
    vectors = chunks.agg(F.count_if(F.col("embedding").isNotNull()).cast("long").alias("number_of_vectors"))
    counts = docs.agg(F.count("*").cast("long").alias("number_of_documents"))
    return counts.withColumn("k", F.lit(1)).join(vectors.withColumn("k", F.lit(1)), "k").drop("k")


def reuse_embeddings(new: DataFrame, old: DataFrame, *, keys: Sequence[str] = ("_id", "field", "chunk_idx")) -> DataFrame:
    """Chunks of `new` with the embedding that `old` has for the same place and the same chunk; null where it has to be made."""
    known = old.select(*keys, F.col("chunk").alias("old_chunk"), F.col("embedding").alias("old_embedding"))
    kept = F.when(F.col("chunk").eqNullSafe(F.col("old_chunk")), F.col("old_embedding"))
    return new.drop("embedding").join(known, list(keys), "left").withColumn("embedding", kept).drop("old_chunk", "old_embedding")


def _marked(name: str):
    return lambda v: F.concat(F.lit(f"{name}::"), v)


def _keyed(name: str, kind: str):
    return lambda e: F.struct(F.concat(F.lit(f"{name}."), e["key"]).alias("key"), e["value"].cast(kind).alias("value"))


def flattened(docs: DataFrame, *, short: int = 50) -> DataFrame:
    """(_id, short_strings, string_arrays, bools, ints, floats): fields of any table in maps by kind, as filters.inferred_filter reads them.

    Strings longer than `short` can't be filtered by; maps of numbers are `field.key`; a null field is none.
    """
    places: dict[str, list[Column]] = {"short_strings": [], "bools": [], "ints": [], "floats": []}
    maps: dict[str, list[Column]] = {"ints": [], "floats": []}
    arrays: list[Column] = []
    casts = {"short_strings": "string", "bools": "boolean", "ints": "bigint", "floats": "double"}
    entry = lambda name, value, test, kind: F.when(test, F.struct(F.lit(name).alias("key"), value.cast(kind).alias("value")))
    for x in docs.schema:
        column, kind = F.col(f"`{x.name}`"), x.dataType
        if x.name == "_id":
            continue
        if isinstance(kind, T.StringType):
            places["short_strings"].append(entry(x.name, column, F.length(column) <= short, "string"))
        elif isinstance(kind, T.BooleanType):
            places["bools"].append(entry(x.name, column, column.isNotNull(), "boolean"))
        elif isinstance(kind, T.IntegralType):
            places["ints"].append(entry(x.name, column, column.isNotNull(), "bigint"))
        elif isinstance(kind, T.NumericType):
            places["floats"].append(entry(x.name, column, column.isNotNull(), "double"))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            arrays.append(F.transform(F.coalesce(column, F.array().cast("array<string>")), _marked(x.name)))
        elif isinstance(kind, T.MapType) and isinstance(kind.valueType, T.NumericType):
            place, of = ("ints", "bigint") if isinstance(kind.valueType, T.IntegralType) else ("floats", "double")
            maps[place].append(F.transform(F.map_entries(F.coalesce(column, F.create_map().cast(kind))), _keyed(x.name, of)))
        else:
            raise ValueError(f"{x.name} has a kind that documents can't have")
    out = []
    for place, entries in places.items():
        none = F.array().cast(f"array<struct<key:string,value:{casts[place]}>>")
        rows = F.concat(F.array_compact(F.array(*entries)) if entries else none, *maps.get(place, []))
        out.append(F.map_from_entries(rows).alias(place))
    return docs.select("_id", *out, (F.flatten(F.array(*arrays)) if arrays else F.array().cast("array<string>")).alias("string_arrays"))


def unflattened(flat: DataFrame) -> DataFrame:
    """(_id, document): the fields again, as JSON, with arrays put together."""
    element = lambda x: F.split(x, "::", 2)
    names = F.array_distinct(F.transform("string_arrays", lambda x: element(x)[0]))
    lists = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter("string_arrays", lambda x: element(x)[0] == n), lambda x: element(x)[1])))
    return flat.select("_id", F.to_json(F.struct("short_strings", "bools", "ints", "floats", lists.alias("string_arrays"))).alias("document"))
