"""Indexes as Parquet tables in one folder, and what users do with them.

`<root>/_indexes` has a row for each change of an index; the row of its largest version counts.  What version n adds stands in
`<root>/<name>/<part>/_version=n`, where the parts are documents, chunks, terms (the inverted index), lengths (sums of words, below
zero for what goes), gone (keys whose earlier rows count no more) and, once built, cells (the chunks of that version by cell) and centres.  A change writes its folders and then its row, so that readers
see either state, and it writes its own rows only: readers take those of all versions since the last whole one but for what is gone.
Once such changes hold half as many rows as the whole version that they follow, the next one writes all anew, so that a row is written a few
times however many batches come.  An index has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.functions.scoring import ScoreModifiers
from tessera.operators import documents as D
from tessera.operators import embedding as E
from tessera.operators import inverted
from tessera.operators.cells import BOUNDED, CENTRES, NOT_DEALT, Cells, cell_search, write_cells
from tessera.operators.lexical import KeywordQuery
from tessera.operators.recommend import recommend
from tessera.operators.search import CustomVector, Hybrid, hybrid_search, lexical_search, scored_page, tensor_search
from tessera.plans.filters import structured_filter
from tessera.plans.spec import IndexSpec

_LOG = "name string, version long, dropped boolean, spec string, base long, rows long"
_CHUNKS = "_id string, field string, chunk_idx int, chunk string, embedding array<float>"
_TERMS = "field string, term string, _id string, tf long, dl long, places array<int>, bucket int"
_LENGTHS = "field string, documents long, rows long, length long"
_GONE = "_id string, vectors boolean"
#: Changes after a whole version at most, as each is a folder to list; the next one writes all anew.
MOST_CHANGES = 500


@dataclass(frozen=True)
class State:
    """An index at one version: `base` is the last whole one, `rows` has the rows that each version since then wrote or took away."""

    version: int
    base: int
    spec: IndexSpec
    rows: tuple[int, ...]

    @property
    def changed_much(self) -> bool:
        return 2 * sum(self.rows[1:]) >= self.rows[0] or len(self.rows) > MOST_CHANGES


class Indexes:
    def __init__(self, spark: SparkSession, root: str, embedders: Mapping[str, E.Embedder] | None = None):
        self.spark, self.root, self.embedders = spark, root.rstrip("/"), dict(embedders or {})

    # -- the catalogue

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/_indexes")
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def list_indexes(self) -> DataFrame:
        """(name, version, spec) of all indexes."""
        last = self._log().groupBy("name").agg(F.max_by(F.struct("version", "dropped", "spec"), "version").alias("last"))
        return last.where(~F.col("last.dropped")).select("name", "last.version", "last.spec")

    def _state(self, name: str) -> State:
        mine = self._log().where(F.col("name") == name)
        last = mine.orderBy(F.desc("version")).limit(1).collect()
        if not last or last[0]["dropped"]:
            raise KeyError(f"no index {name}")
        since = mine.where(F.col("version") >= last[0]["base"]).select("version", "rows").orderBy("version").collect()  # MOST_CHANGES bounds them
        return State(last[0]["version"], last[0]["base"], IndexSpec.from_json(last[0]["spec"]), tuple(x["rows"] for x in since))

    def _note(self, name: str, version: int, spec: IndexSpec | None, base: int = 0, rows: int = 0) -> None:
        row = [(name, version, spec is None, spec.to_json() if spec else None, base, rows)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_indexes")

    def _last_version(self, name: str) -> int:
        return self._log().where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    # -- the parts of an index

    def _folder(self, name: str, part: str, version: int) -> str:
        return f"{self.root}/{name}/{part}/_version={version}"

    def _rows(self, name: str, part: str, schema: T.StructType | str, first: int, last: int) -> DataFrame:
        """The rows of a part that versions `first` to `last` wrote, with _version."""
        schema = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField("_version", T.LongType())])
        folders = [self._folder(name, part, x) for x in range(first, last + 1)]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}/{part}").parquet(*folders)

    def _live(self, state: State, part: str, schema: T.StructType | str) -> DataFrame:
        """The rows of a part that count.  Keys that are gone are few next to the whole version, so that they are what moves."""
        name = state.spec.name
        rows = self._rows(name, part, schema, state.base, state.version)
        if state.version == state.base:
            return rows.drop("_version")
        return self._without_gone(state, part, rows, state.base)

    def _without_gone(self, state: State, part: str, rows: DataFrame, after: int) -> DataFrame:
        """`rows`, which count at version `after` or are younger, less those of keys that are gone since."""
        gone = self._rows(state.spec.name, "gone", _GONE, after + 1, state.version)
        gone = gone.where("vectors") if part == "chunks" else gone
        last = gone.groupBy(F.col("_id").alias("gone_id")).agg(F.max("_version").alias("until"))
        return rows.join(last, (F.col("_id") == F.col("gone_id")) & (F.col("_version") < F.col("until")), "left_anti").drop("_version")

    def _documents(self, state: State, spec: IndexSpec | None = None) -> DataFrame:
        return self._live(state, "documents", (spec or state.spec).schema())

    def _chunks(self, state: State) -> DataFrame:
        return self._live(state, "chunks", _CHUNKS)

    def build_cells(self, name: str, *, cells: int = 256, **options) -> None:
        """Stores the chunks by cell (see operators.cells), which tensor search then reads.

        Later changes are read beside the cells, until a whole version is written; build them anew then.  Without vectors, or with
        cells of this version already there, nothing is done.
        """
        state = self._state(name)
        if state.spec.distance_metric not in BOUNDED:
            raise ValueError(f"cells know the metrics {', '.join(BOUNDED)}")
        chunks, known = self._chunks(state), self._cells_version(state)
        if known == state.version or chunks.where("embedding is not null").isEmpty():
            return
        build = uuid4().hex  # what a build that failed has left is never read
        rows = f"{self._folder(name, 'cells', state.version)}/_build={build}"
        write_cells(chunks, rows, f"{self._folder(name, 'centres', state.version)}/_build={build}", metric=state.spec.distance_metric, cells=cells, **options)

    def _centres(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{CENTRES}, _version long, _build string").parquet(f"{self.root}/{name}/centres")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{CENTRES}, _version long, _build string")

    def _cells_version(self, state: State) -> int | None:
        """The version whose chunks were dealt last, if what it took from is not written anew since."""
        last = self._centres(state.spec.name).where(F.col("_version") <= state.version).agg(F.max("_version")).first()[0]
        return last if last is not None and last >= state.base else None

    def _cells(self, state: State) -> Cells | None:
        """The live chunks by cell; those that are younger than the cells are in none."""
        name, version = state.spec.name, self._cells_version(state)
        if version is None:
            return None
        centres = self._centres(name).where(F.col("_version") == version)
        build = centres.agg(F.max("_build")).first()[0]
        rows = self.spark.read.schema(f"{_CHUNKS}, cell_ int").parquet(f"{self._folder(name, 'cells', version)}/_build={build}")
        if version < state.version:
            younger = self._rows(name, "chunks", _CHUNKS, version + 1, state.version).withColumn("cell_", F.lit(NOT_DEALT))
            rows = self._without_gone(state, "chunks", rows.withColumn("_version", F.lit(version).cast("long")).unionByName(younger), version)
        return Cells.of_rows(rows, centres.where(F.col("_build") == build), state.spec.distance_metric)

    def _write(self, spec: IndexSpec, docs: DataFrame, chunks: DataFrame, state: State | None = None, gone: DataFrame | None = None) -> None:
        """A new version: `docs` and `chunks` are all rows, or, with `gone` (_id, vectors), what stands in place of the rows of these keys.

        Where vectors is false the chunks of a key stay.
        """
        version, name, fields = self._last_version(spec.name) + 1, spec.name, self._indexed(spec)
        base, removed = version, None
        if gone is not None:
            gone.select("_id", "vectors").distinct().write.parquet(self._folder(name, "gone", version))
            gone = self._rows(name, "gone", _GONE, version, version).drop("_version")
            if state.changed_much or fields != self._indexed(state.spec):
                docs = self._documents(state, spec).join(gone, "_id", "left_anti").unionByName(docs, allowMissingColumns=True)
                chunks = self._chunks(state).join(gone.where("vectors"), "_id", "left_anti").unionByName(chunks)
            else:
                base, removed = state.base, self._live(state, "documents", "_id string, _words array<int>").join(gone, "_id", "left_semi")
        inverted.with_words(docs, fields).write.parquet(self._folder(name, "documents", version))
        chunks.write.partitionBy("field").parquet(self._folder(name, "chunks", version))
        written = self._rows(name, "documents", spec.schema().add("_words", T.ArrayType(T.IntegerType())), version, version)
        if fields:
            # By range, so that a frequent term is in several files.
            terms = inverted.index_terms(written, fields).repartitionByRange("bucket", "term", "_id").sortWithinPartitions("bucket", "term")
            terms.write.partitionBy("bucket").parquet(self._folder(name, "terms", version))
            signed = written.select("_words", F.lit(1).alias("sign"))
            signed = signed if removed is None else signed.unionByName(removed.select("_words", F.lit(-1).alias("sign")))
            inverted.lengths_of_words(signed, fields).write.parquet(self._folder(name, "lengths", version))
        rows = written.count() + (0 if removed is None else gone.count())
        self._note(name, version, spec, base, rows)

    @staticmethod
    def _indexed(spec: IndexSpec) -> list[str]:
        """Text fields that keyword search reads from the inverted index."""
        return [x for x in spec.with_feature("lexical_search") if spec.schema()[x].dataType.simpleString() == "string"]

    def _keyword_scores(self, name: str, q: str, fields: Sequence[str]) -> DataFrame | None:
        """(_id, _score) from the inverted index, or None where a query or its fields have to be read from the documents."""
        state = self._state(name)
        if KeywordQuery.of(q).everything or not fields or {*fields} - {*self._indexed(state.spec)}:
            return None
        lengths = self._rows(name, "lengths", _LENGTHS, state.base, state.version)
        sums = lengths.groupBy("field").agg(*(F.sum(x).alias(x) for x in ("documents", "rows", "length")))
        return inverted.index_search(self._live(state, "terms", _TERMS), sums, q, list(fields))

    def create_index(self, spec: IndexSpec) -> None:
        if self.list_indexes().where(F.col("name") == spec.name).count():
            raise ValueError(f"there is an index {spec.name}")
        self._write(spec, self.spark.createDataFrame([], spec.schema()), self.spark.createDataFrame([], _CHUNKS))

    def create_indexes(self, specs: Sequence[IndexSpec]) -> None:
        for spec in specs:
            self.create_index(spec)

    def delete_index(self, name: str) -> None:
        self._note(name, self._state(name).version + 1, None)

    def delete_indexes(self, names: Sequence[str]) -> None:
        for name in names:
            self.delete_index(name)

    def settings(self, name: str) -> IndexSpec:
        return self._state(name).spec

    # -- documents

    def documents(self, name: str) -> DataFrame:
        return self._documents(self._state(name))

    def chunks(self, name: str) -> DataFrame:
        return self._chunks(self._state(name))

    def compact(self, name: str) -> None:
        """A whole version of what counts now; changes do this by themselves once they are many."""
        state = self._state(name)
        self._write(state.spec, self._documents(state), self._chunks(state))

    def add_documents(self, name: str, batch: DataFrame, *, reuse: bool = False, token: str | None = None, mappings: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
        """Adds or replaces whole documents; of `batch` (pos, fields) the last row of each _id counts.  Gives (pos, _id, status, error).

        Columns that name a tensor field are chunked and embedded; bad rows are told and left out.  Rows without _id get one
        made of the row and `token`, the batch's name: a batch that is run again under one name gives the same documents.
        `mappings` has other weights of combinations' parts for this batch.
        """
        state = self._state(name)
        spec = state.spec
        if "pos" not in batch.columns:
            batch = batch.withColumn("pos", F.monotonically_increasing_id())
        batch = D.last_of_each(D.with_ids(batch, token or uuid4().hex))
        grown = spec.grown(batch.drop("pos"))
        known = {x.name for x in grown.fields} | {"_id", "pos"}
        if unknown := {*batch.columns} - known:
            raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
        checked = D.validated(batch, {k: v for k, v in grown.rules().items() if k.split()[0] in batch.columns}).persist()
        good = checked.where("status = 200").drop("pos", "status", "error")
        texts = [x for x in grown.tensor_fields if x in batch.columns and dict(batch.dtypes)[x] == "string"]
        parts = [E.chunked(good, texts, by=grown.split_method, length=grown.split_length, overlap=grown.split_overlap)] if texts else []
        made = None
        if parts:
            new = parts[0].withColumn("embedding", F.lit(None).cast("array<float>"))
            new = D.reuse_embeddings(new, self._chunks(state)) if reuse else new
            made = E.embedded(new, self.embedders.get(grown.model, E.HashEmbedder(grown.dimensions)), prefix=grown.chunk_prefix, normalise=grown.normalize_embeddings)
        for x in grown.fields:
            if x.kind == "custom_vector" and x.name in batch.columns:
                own = E.custom_vectors(good, x.name, dimensions=grown.dimensions, normalise=grown.normalize_embeddings)
                made = own if made is None else made.unionByName(own)
        for x in grown.fields:
            if x.kind == "multimodal_combination":
                pieces = E.embedded(good.select("_id", F.explode(F.array(*(F.struct(F.lit(y).alias("field"), F.col(f"`{y}`").alias("chunk")) for y in x.dependent_fields if y in batch.columns))).alias("f")).select("_id", "f.*").where("chunk is not null"), self.embedders.get(grown.model, E.HashEmbedder(grown.dimensions)), normalise=grown.normalize_embeddings)
                weights = dict(x.dependent_fields)
                if other := (mappings or {}).get(x.name):
                    if unknown := {*other} - {*weights}:
                        raise ValueError(f"{x.name} has no parts {', '.join(sorted(unknown))}")
                    weights |= other
                own = E.combined(pieces, weights, name=x.name, normalise=grown.normalize_embeddings)
                made = own if made is None else made.unionByName(own)
        made = self.spark.createDataFrame([], _CHUNKS) if made is None else made.select(*(F.col(x.name).cast(x.dataType) for x in T.StructType.fromDDL(_CHUNKS)))
        self._write(grown, good, made, state, good.select("_id", F.lit(True).alias("vectors")))
        result = checked.select("pos", "_id", "status", "error").persist()
        result.count()
        checked.unpersist()
        return result

    def update_documents(self, name: str, patches: DataFrame) -> DataFrame:
        """Changes fields of documents that exist; tensor fields, and what combinations are made of, can't be changed."""
        state = self._state(name)
        spec = state.spec
        fixed = {*spec.tensor_fields} | {y for x in spec.fields for y in x.dependent_fields or ()}
        if bad := fixed & {*patches.columns}:
            raise ValueError(f"these fields have vectors: {', '.join(sorted(bad))}")
        patches = patches.persist()
        asked = self._documents(state).join(patches.select("_id"), "_id", "left_semi")
        docs, status = D.partial_update(asked, patches)
        status = status.persist()
        status.count()
        self._write(spec, docs, self.spark.createDataFrame([], _CHUNKS), state, patches.select("_id", F.lit(False).alias("vectors")))
        patches.unpersist()
        return status

    def get_document(self, name: str, key: str) -> DataFrame:
        return self.documents(name).where(F.col("_id") == key)

    def get_documents(self, name: str, keys: Sequence[str]) -> DataFrame:
        ids = self.spark.createDataFrame([*enumerate(keys)], "pos int, _id string")
        return D.get_documents(self.documents(name), ids).orderBy("pos")

    def delete_documents(self, name: str, keys: Sequence[str]) -> DataFrame:
        state = self._state(name)
        ids = self.spark.createDataFrame([(x,) for x in keys], "_id string")
        self._write(state.spec, self.spark.createDataFrame([], state.spec.schema()), self.spark.createDataFrame([], _CHUNKS), state, ids.withColumn("vectors", F.lit(True)))
        return ids.withColumn("status", F.lit(200))

    def delete_all_documents(self, name: str) -> int:
        state = self._state(name)
        count = self._documents(state).count()
        self._write(state.spec, self.spark.createDataFrame([], state.spec.schema()), self.spark.createDataFrame([], _CHUNKS))
        return count

    def stats(self, name: str) -> DataFrame:
        return D.index_stats(self.documents(name), self.chunks(name))

    # -- search

    def _where(self, name: str, docs: DataFrame, filter_: str | None) -> Column | None:
        spec = self.settings(name)
        return structured_filter(docs, filter_, filterable={*spec.with_feature("filter")}) if filter_ else None

    def embed(self, name: str, content: Sequence[str], *, prefix: str | None = None) -> DataFrame:
        """(pos, chunk, embedding) of texts."""
        spec = self.settings(name)
        rows = self.spark.createDataFrame([*enumerate(content)], "pos int, chunk string")
        return E.embedded(rows, self.embedders.get(spec.model, E.HashEmbedder(spec.dimensions)), prefix=prefix, normalise=spec.normalize_embeddings).orderBy("pos")

    def search(
        self, name: str, q: str | Mapping[str, float] | CustomVector | None = None, *, method: str = "TENSOR", limit: int = 10, offset: int = 0, filter: str | None = None, searchable_attributes: Sequence[str] | None = None,
        score_modifiers: ScoreModifiers | None = None, context: Sequence[tuple[Sequence[float], float]] = (), hybrid: Hybrid | None = None, text_query_prefix: str | None = None, approximate: bool | None = None,
    ) -> DataFrame:
        """One page of hits by TENSOR, LEXICAL or HYBRID search.

        Where a keyword arm takes part, `q` is a text or a CustomVector with one as its content.  Without `q`, or with
        weighted texts, HYBRID search is tensor/tensor only, and without `q` it needs a context.  TENSOR search is exact; where cells were
        built and scores aren't modified it reads those that the page can need, or, if `approximate`, the nearest few alone.
        """
        spec, docs = self.settings(name), self.documents(name)
        where = self._where(name, docs, filter)
        if method != "HYBRID" and hybrid is not None:
            raise ValueError("hybrid parameters go with HYBRID")
        if method == "LEXICAL":
            if not isinstance(q, str) or context:
                raise ValueError("keyword search takes a text")
            if approximate is not None:
                raise ValueError("keyword search is never approximate")
            fields = list(searchable_attributes or spec.with_feature("lexical_search"))
            if (scores := self._keyword_scores(name, q, fields)) is None:
                return lexical_search(docs, q, fields, where=where, modifiers=score_modifiers, limit=limit, offset=offset)
            return scored_page(docs, scores, where=where, modifiers=score_modifiers, limit=limit, offset=offset)
        text = q if isinstance(q, str) else None
        if isinstance(q, CustomVector):
            q, text, context = None, q.content, [*context, (q.vector, 1.0)]
        if method == "HYBRID" and q is None and not context:
            raise ValueError("a search without a query needs a context")
        prefix = text_query_prefix if text_query_prefix is not None else spec.query_prefix
        vector = E.embed_query(q, self.embedders.get(spec.model, E.HashEmbedder(spec.dimensions)), context=context, prefix=prefix, normalise=spec.normalize_embeddings)
        if method == "TENSOR":
            if searchable_attributes and (unknown := {*searchable_attributes} - {*spec.tensor_fields}):
                raise ValueError(f"no tensor fields: {', '.join(sorted(unknown))}")
            if score_modifiers is None and (index := self._cells(self._state(name))):
                return cell_search(index, vector, docs=docs, fields=searchable_attributes, where=where, limit=limit, offset=offset, exact=not approximate)
            return tensor_search(self.chunks(name), vector, docs=docs, metric=spec.distance_metric, fields=searchable_attributes, where=where, modifiers=score_modifiers, limit=limit, offset=offset)
        if method == "HYBRID":
            if score_modifiers or searchable_attributes:
                raise ValueError("in hybrid search modifiers and attributes belong to the arms")
            known = ((hybrid.tensor_attributes, spec.tensor_fields), (hybrid.keyword_attributes, spec.with_feature("lexical_search"))) if hybrid else ()
            if unknown := {x for asked, fields in known for x in asked or () if x not in fields}:
                raise ValueError(f"no fields of the arm: {', '.join(sorted(unknown))}")
            return hybrid_search(docs, self.chunks(name), text, vector, keyword_fields=spec.with_feature("lexical_search"), hybrid=hybrid, metric=spec.distance_metric, where=where, limit=limit, offset=offset)
        raise ValueError(f"unknown method {method!r}")

    def recommend(self, name: str, documents: Sequence[str] | Mapping[str, float], *, limit: int = 10, offset: int = 0, filter: str | None = None, **options) -> DataFrame:
        spec, docs = self.settings(name), self.documents(name)
        return recommend(self.chunks(name), documents, docs=docs, normalised=spec.normalize_embeddings, metric=spec.distance_metric, where=self._where(name, docs, filter), limit=limit, offset=offset, **options)
