"""An index on disk in versions: segments that are only added, deletions beside them, a manifest that is swapped.

    manifest.json              the current version
    versions/N.json            all versions, N with leading zeros
    chunks/segment=S           chunks with `ord`, their number in the segment; `embedding_text` only where it is not `text`
    documents/segment=S
    postings/segment=S/bucket=B (none for a segment without chunks; the manifest lists those that have some as `indexed`)
    gone/deletion=D            (segment, ord, chunk_id, doc_id, length, tokens) of deleted chunks
    gone_documents/deletion=D  (segment, doc_id)
    gone_terms/deletion=D      (bucket, term, n): in how many deleted chunks a term stood

A change writes new folders only and then swaps manifest.json, so a reader sees the version before it
or the one after, and a change that broke off leaves nothing but folders that no manifest names.
One writer at a time: a writer whose version is no longer the current one is refused. Old versions
can be read until `compact` is followed by `vacuum`.

Texts are what takes the disk. They are written compressed (CODEC) and do not travel to meet the keys of what
was deleted, as long as those can be broadcast; to be verified, documents travel a part (PARTS) at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import bm25_tokens
from lodestar.operators import postings as P
from lodestar.operators.chunking import verify
from lodestar.operators.index import IndexFault, repeated_ids
from lodestar.operators.search import K1, B, bounded, valid_vector
from lodestar.operators.tables import CODEC, exists, read_json, released, remove, write_json

FORMAT = 3
#: Keys of deleted chunks or documents that are broadcast, and the parts in which documents meet their chunks.
KEYS, PARTS = 1_000_000, 4
# A fixed text whose tokens tell tokenizers apart: compatibility forms, case folding, joiners, scripts, digits.
PROBE = "Lodestar's ½ naïve Straße ﬁle_1 don't 日本語 ΟΔΟΣ x² İstanbul e-mail 3.14"
_WORD = 1 << 32


def id_digest(table: DataFrame, column: str = "chunk_id") -> list[int]:
    """Number of rows and a 128-bit digest of the ids that does not depend on their order: one narrow pass. Digests add up."""
    a, b = F.xxhash64(F.lit(1), F.col(column).cast("string")), F.xxhash64(F.lit(2), F.col(column).cast("string"))
    words = [w for h in (a, b) for w in (h.bitwiseAND(_WORD - 1), F.shiftrightunsigned(h, 32))]
    row = table.agg(F.count("*"), *[F.sum(w.cast("decimal(20,0)")) for w in words]).first()
    return [int(row[0]), *(int(x or 0) % _WORD for x in row[1:])]


def _plus(a: list[int], b: list[int], sign: int = 1) -> list[int]:
    return [a[0] + sign * b[0], *((x + sign * y) % _WORD for x, y in zip(a[1:], b[1:], strict=True))]


def tokenizer_digest(spark: SparkSession, tokenizer: P.Tokenizer) -> str:
    tokens = spark.range(1).select(tokenizer(F.lit(PROBE)).alias("t")).first()["t"]
    return hashlib.sha256("\n".join(tokens).encode()).hexdigest()


def _slim(chunks: DataFrame) -> DataFrame:
    """Chunks as they are written: `embedding_text` as a struct, null where it is the text."""
    return chunks.withColumn("embedding_text", F.when(~F.col("embedding_text").eqNullSafe(F.col("text")), F.struct(F.col("embedding_text").alias("value"))))


def _full(chunks: DataFrame) -> DataFrame:
    """Chunks that were written as `_slim` has them."""
    return chunks.withColumn("embedding_text", F.when(F.col("embedding_text").isNull(), F.col("text")).otherwise(F.col("embedding_text.value")))


def disagreeing(chunks: DataFrame, docs: DataFrame, most: int) -> list:
    """Up to `most` of the rows of `verify`. Documents travel PARTS times a part of them, so that they are never all in shuffle files."""
    found: list = []
    for part in range(PARTS):
        own = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PARTS)) == part
        found += verify(chunks.where(own), docs.where(own)).limit(most - len(found)).collect()
        released(chunks.sparkSession)
        if len(found) >= most:
            break
    return found


class Store:
    """A version of an index. Changes return the store of the next version."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, tokenizer: P.Tokenizer = bm25_tokens):
        self.spark, self.path, self.manifest, self.tokenizer = spark, path.rstrip("/"), manifest, tokenizer

    # --- reading --------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, tokenizer: P.Tokenizer = bm25_tokens) -> Store:
        """The current or a given version. Refused: no manifest, another format, a tokenizer that cuts other tokens."""
        where = f"{path.rstrip('/')}/manifest.json" if version is None else f"{path.rstrip('/')}/versions/{version:08d}.json"
        if not exists(spark, where):
            raise IndexFault("not an index directory: no manifest" if version is None else f"no version {version}")
        manifest = read_json(spark, where)
        if manifest.get("format") != FORMAT:
            raise IndexFault(f"unknown format: {manifest.get('format')}")
        if version is not None and version > read_json(spark, f"{path.rstrip('/')}/manifest.json")["version"]:
            raise IndexFault(f"version {version} was never finished")
        if manifest["tokenizer"] != tokenizer_digest(spark, tokenizer):
            raise IndexFault("the tokenizer is not the one this index was built with")
        return cls(spark, path, manifest, tokenizer)

    def _read(self, kind: str, part: str, names: list[str]) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{part}={n}" for n in names]) if names else None

    def _gone(self, kind: str = "gone") -> DataFrame | None:
        return self._read(kind, "deletion", self.manifest["deletions"])

    def _left(self, held: DataFrame, kind: str, keys: list[str]) -> DataFrame:
        """`held` without what was deleted since."""
        gone = self._gone(kind)
        return held if gone is None else held.join(bounded(gone.select(keys), KEYS), keys, "left_anti")

    def chunks(self) -> DataFrame:
        """Live chunks with segment and ord; their order is that of (segment, ord)."""
        return self._left(_full(self._read("chunks", "segment", self.manifest["segments"])), "gone", ["segment", "ord"])

    def documents(self) -> DataFrame:
        return self._left(self._read("documents", "segment", self.manifest["segments"]), "gone_documents", ["segment", "doc_id"]).drop("segment")

    def postings(self) -> P.Postings:
        rows = self._read("postings", "segment", self.manifest["indexed"])
        if rows is None:
            kind = dict(self.chunks().dtypes)["chunk_id"]
            rows = self.spark.createDataFrame([], f"term string, block long, n long, top_tf int, least_length int, places array<int>, tfs array<int>, ids array<{kind}>, segment string, bucket int")
        gone, terms = self._gone(), self._gone("gone_terms")
        gone = None if gone is None else gone.select("segment", F.expr(f"ord div {P.BLOCK}").alias("block"), (F.col("ord") % P.BLOCK).cast("int").alias("place"))
        return P.Postings(rows, self.manifest["chunks"], self.manifest["tokens"], gone, None if terms is None else terms.select("bucket", "term", "n"))

    def places(self, chunks: DataFrame) -> DataFrame:
        """(segment, block, place) of chunks of this store: what `Postings.search` keeps."""
        return chunks.select("segment", F.expr(f"ord div {P.BLOCK}").alias("block"), (F.col("ord") % P.BLOCK).cast("int").alias("place"))

    def check(self) -> None:
        """Refuses a store whose tables don't hold what the manifest says: counts, the set of ids in the chunks and in the lexical index, total length, vectors, offsets."""
        m, chunks, docs = self.manifest, self.chunks(), self.documents()
        if docs.count() != m["documents"]:
            raise IndexFault("the documents are not as many as the manifest says")
        if id_digest(chunks) != [m["chunks"], *m["digest"]]:
            raise IndexFault("the chunks are not those of the manifest")
        heads = self.postings().heads().select("segment", "block", F.explode(F.arrays_zip("places", "lengths", "ids")).alias("x")).select("segment", "block", F.col("x.places").alias("place"), F.col("x.lengths").alias("length"), F.col("x.ids").alias("chunk_id"))
        gone = self.postings().gone
        live = heads if gone is None else heads.join(gone, ["segment", "block", "place"], "left_anti")
        if id_digest(live) != [m["chunks"], *m["digest"]]:
            raise IndexFault("the lexical index does not hold the same chunks as the dense one")
        if (live.agg(F.sum("length")).first()[0] or 0) != m["tokens"]:
            raise IndexFault("the lexical index has another total length than the manifest says")
        if chunks.where(~valid_vector(F.col("embedding"), m["dimension"])).limit(1).count():
            raise IndexFault("vectors of another dimension, or not finite")
        if disagreeing(chunks, docs, 1):
            raise IndexFault("chunks do not agree with their documents")

    def drift(self, tokenizer: P.Tokenizer | None = None) -> tuple[int, int]:
        """(total length that is stored, total length that `tokenizer` cuts now) of the live chunks."""
        cut = self.chunks().select(F.size((tokenizer or self.tokenizer)(F.coalesce("embedding_text", F.lit("")))).alias("n")).agg(F.sum("n")).first()[0]
        return self.manifest["tokens"], int(cut or 0)

    # --- writing --------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, chunks: DataFrame, docs: DataFrame, embedder: str, dimension: int, k1: float = K1, b: float = B, tokenizer: P.Tokenizer = bm25_tokens) -> Store:
        """A store of these chunks and documents; the next version of one that stands here already."""
        path = path.rstrip("/")
        old = read_json(spark, f"{path}/manifest.json") if exists(spark, f"{path}/manifest.json") else None
        old = old if old and old.get("format") == FORMAT else None
        base = {
            "format": FORMAT, "version": old["version"] if old else 0, "embedder": embedder, "dimension": dimension, "chunks": 0, "documents": 0, "tokens": 0, "digest": [0] * 4,
            "bm25": {"k1": k1, "b": b}, "tokenizer": tokenizer_digest(spark, tokenizer), "segments": [], "indexed": [], "deletions": [],
        }
        return cls(spark, path, base, tokenizer)._changed(None, None, chunks, docs, old["version"] if old else None)

    def upsert(self, chunks: DataFrame, docs: DataFrame) -> Store:
        """All chunks of the batch's documents, and chunks of the batch's ids, are replaced by the batch's."""
        self._require_current(self.manifest["version"])
        old = self.chunks()
        stale = old.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("segment", "ord")
        stale = stale.unionByName(old.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("segment", "ord")).distinct()
        stale = bounded(stale, KEYS)
        return self._changed(old.join(stale, ["segment", "ord"], "left_semi"), docs.select("doc_id").distinct(), chunks, docs, self.manifest["version"])

    def delete(self, doc_ids: DataFrame) -> tuple[Store, int]:
        """Without the documents `doc_ids` (doc_id), and the number of chunks that went. Without any, nothing is written."""
        self._require_current(self.manifest["version"])
        own = doc_ids.select("doc_id").distinct()
        known = self.documents().join(own, "doc_id", "left_semi")
        if not known.limit(1).count():
            return self, 0
        after = self._changed(self.chunks().join(bounded(own, KEYS), "doc_id", "left_semi"), own, None, None, self.manifest["version"])
        return after, self.manifest["chunks"] - after.manifest["chunks"]

    def compact(self) -> Store:
        """The next version in one segment, without deletions."""
        base = self.manifest | {"chunks": 0, "documents": 0, "tokens": 0, "digest": [0] * 4, "segments": [], "indexed": [], "deletions": []}
        return Store(self.spark, self.path, base, self.tokenizer)._changed(None, None, self.chunks().drop("segment", "ord"), self.documents(), self.manifest["version"])

    def vacuum(self) -> list[str]:
        """Deletes the folders that this version does not name, and the versions before it; returns their names. For when no one reads older versions."""
        jvm, gone = self.spark._jvm, []
        for kind, part in (("chunks", "segment"), ("documents", "segment"), ("postings", "segment"), ("gone", "deletion"), ("gone_documents", "deletion"), ("gone_terms", "deletion")):
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(where) if fs.exists(where) else ():
                name = status.getPath().getName()
                if name not in {f"{part}={n}" for n in self.manifest[f"{part}s"]}:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
                    gone.append(f"{kind}/{name}")
        for version in range(1, self.manifest["version"]):
            remove(self.spark, f"{self.path}/versions/{version:08d}.json")
        return sorted(gone)

    def _changed(self, stale: DataFrame | None, stale_docs: DataFrame | None, chunks: DataFrame | None, docs: DataFrame | None, base: int | None) -> Store:
        manifest = dict(self.manifest)
        name = f"{manifest['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        if chunks is not None:
            chunks = self._fitting(chunks, docs)
        if stale is not None:
            manifest = self._deleted(manifest, f"d{name}", stale, stale_docs)
        if chunks is not None:
            manifest = self._added(manifest, f"s{name}", chunks, docs)
        manifest["version"] += 1
        self._require_current(base)
        write_json(self.spark, f"{self.path}/versions/{manifest['version']:08d}.json", manifest)
        write_json(self.spark, f"{self.path}/manifest.json", manifest)
        released(self.spark)
        return Store(self.spark, self.path, manifest, self.tokenizer)

    def _require_current(self, base: int | None) -> None:
        here = f"{self.path}/manifest.json"
        if base is not None and (current := read_json(self.spark, here)["version"]) != base:
            raise IndexFault(f"version {base} is no longer the current one ({current})")

    def _fitting(self, chunks: DataFrame, docs: DataFrame) -> DataFrame:
        chunks = chunks.drop("segment", "ord")
        if "embedding_text" not in chunks.columns:
            chunks = chunks.withColumn("embedding_text", F.col("text"))
        if repeated_ids(chunks).limit(1).count():
            raise IndexFault("a chunk_id is there twice")
        if chunks.where(~valid_vector(F.col("embedding"), self.manifest["dimension"])).limit(1).count():
            raise IndexFault("vectors of another dimension, or not finite")
        wrong = disagreeing(chunks, docs, 3)
        if wrong:
            raise IndexFault(f"chunks do not agree with their documents: {wrong}")
        if self.manifest["segments"]:
            own = self._read("chunks", "segment", self.manifest["segments"][-1:]).drop("segment", "ord")
            if set(own.columns) != set(chunks.columns):
                raise IndexFault(f"the batch has other columns than the index: {sorted(set(own.columns) ^ set(chunks.columns))}")
        return chunks

    def _deleted(self, manifest: dict, name: str, stale: DataFrame, stale_docs: DataFrame) -> dict:
        tokens = F.coalesce(self.tokenizer(F.col("embedding_text")), F.array().cast("array<string>"))
        where = f"{self.path}/gone/deletion={name}"
        stale.select("segment", "ord", "chunk_id", "doc_id", tokens.alias("tokens")).withColumn("length", F.size("tokens").cast("long")).write.options(**CODEC).parquet(where)
        gone = self.spark.read.parquet(where)
        terms = gone.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        terms.select(P.bucket(F.col("term")).alias("bucket"), "term", "n").write.options(**CODEC).parquet(f"{self.path}/gone_terms/deletion={name}")
        held = reduce(DataFrame.unionByName, [self._read("documents", "segment", [s]).select("segment", "doc_id") for s in manifest["segments"]])
        before = self._gone("gone_documents")
        held = held if before is None else held.join(before.select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")
        held.join(stale_docs, "doc_id", "left_semi").write.parquet(f"{self.path}/gone_documents/deletion={name}")
        digest = _plus([manifest["chunks"], *manifest["digest"]], id_digest(gone), -1)
        return manifest | {
            "deletions": [*manifest["deletions"], name], "chunks": digest[0], "digest": digest[1:], "tokens": manifest["tokens"] - int(gone.agg(F.sum("length")).first()[0] or 0),
            "documents": manifest["documents"] - self.spark.read.parquet(f"{self.path}/gone_documents/deletion={name}").count(),
        }

    def _added(self, manifest: dict, name: str, chunks: DataFrame, docs: DataFrame) -> dict:
        where = f"{self.path}/chunks/segment={name}"
        _slim(chunks).withColumn("ord", F.monotonically_increasing_id()).write.options(**CODEC).parquet(where)
        added = _full(self.spark.read.parquet(where))
        P.write(P.build(added, tokenizer=self.tokenizer), f"{self.path}/postings/segment={name}")
        released(self.spark)  # before more is written
        docs.write.options(**CODEC).parquet(f"{self.path}/documents/segment={name}")
        digest = _plus([manifest["chunks"], *manifest["digest"]], id_digest(added))
        out = manifest | {"chunks": digest[0], "digest": digest[1:], "segments": [*manifest["segments"], name], "documents": manifest["documents"] + self.spark.read.parquet(f"{self.path}/documents/segment={name}").count()}
        if digest[0] == manifest["chunks"]:  # no chunks, so no postings to read
            return out
        lengths = self.spark.read.parquet(f"{self.path}/postings/segment={name}/bucket=-1").select(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
        return out | {"indexed": [*manifest["indexed"], name], "tokens": manifest["tokens"] + int(lengths or 0)}


def metadata_matches(metadata: Column, key: str, value: object) -> Column:
    """Filter on a field of a JSON object: equality, any of a list, overlap where the field is a list. Values are compared with their kinds (2 is not "2", but 2 is 2.0); a missing field never matches."""
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    words = [v for v in values if isinstance(v, str)]
    numbers = [float(v) for v in values if not isinstance(v, (str, bool))]
    truths = [v for v in values if isinstance(v, bool)]
    field = F.element_at(F.from_json(metadata, "map<string,variant>"), F.lit(key))
    listed = F.schema_of_variant(field).startswith("ARRAY")
    items = F.when(listed, F.try_variant_get(field, "$", "array<variant>")).otherwise(F.array(field))

    def fits(x: Column) -> Column:
        kind, hit = F.schema_of_variant(x), F.lit(False)
        if words:
            hit = hit | ((kind == "STRING") & F.try_variant_get(x, "$", "string").isin(words))
        if numbers:
            hit = hit | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & F.try_variant_get(x, "$", "double").isin(numbers))
        if truths:
            hit = hit | ((kind == "BOOLEAN") & F.try_variant_get(x, "$", "boolean").isin(truths))
        return F.coalesce(hit, F.lit(False))

    return F.coalesce(F.exists(items, fits), F.lit(False))
