"""A corpus that is loaded bit by bit (A4): versioned tables behind a manifest.

``CorpusStore.load`` takes whatever diffs have landed, old or new, and parses
those alone whose content or options differ from what the registry holds. Of
several versions of a diff the newest counts, by modification time, whatever
the order of arrival. Layout under ``root``:

* ``<table>/gen=<g>/bucket=<b>/`` - Parquet, ``b`` a hash of the diff_id. A load
  writes new folders for the buckets that hold a changed diff (their other
  rows are copied) and touches no folder that a reader may use; repeating a
  load that failed overwrites just the folders it had begun.
* ``manifest/<g>.json`` - for each table the generation of each bucket. Creating
  it is the commit: readers see all tables before it or after it. Two loads at
  once can't both create it; the second fails and can be repeated.

Tables: ``registry`` (a row for each version of a diff: key, options, times,
status, error), ``chunks``, ``chunk_files``, ``diff_stats``. Rows are sorted by diff
and chunk in their files, with Parquet bloom filters on ``diff_id``, so a lookup
reads one bucket's folder and there the row groups that may hold the diff.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.globs import glob_match
from patchloom.operators.chunks import CHUNK_COLUMNS, chunk_files, summary_col
from patchloom.operators.lookup import render
from patchloom.options import LoadOptions, check_chunk_number, check_pattern
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.files import NAMED_FILES, _binary, _is_folder, check_path, content_key, escaped, list_files, read_diff_files
from patchloom.sources.store import DEFAULT_BUCKETS, bucket_of

SCHEMAS = {
    "registry": "diff_id string, version bigint, content_key string, options string, modification_time timestamp, status string, error string, generation bigint",
    "chunks": "diff_id string, chunk bigint, files array<string>, lines bigint, parent_file string, sub_chunk_index int, content string",
    "chunk_files": "diff_id string, path string, chunk bigint",
    "diff_stats": "diff_id string, total_lines bigint, chunks_count bigint, total_files bigint",
}
SORT = {"registry": ["diff_id", "version"], "chunks": ["diff_id", "chunk"], "chunk_files": ["diff_id", "path", "chunk"], "diff_stats": ["diff_id"]}
#: Ids of changed diffs that may be broadcast to the buckets being rewritten.
BROADCAST_IDS = 1_000_000
#: What the registry says of a diff without chunks.
ERRORS = {"no_diff_content": "No valid diff content found", "all_filtered": "No chunks created", "empty": "File is empty"}


def options_text(options: LoadOptions) -> str:
    return json.dumps(dataclasses.asdict(options), sort_keys=True)


class CorpusStore:
    """Tables of all diffs loaded so far, under ``root`` (any path Spark can write)."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = DEFAULT_BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.n_buckets = self.manifest()["n_buckets"] if self.generation() else n_buckets

    # --- the manifest
    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def generation(self) -> int:
        """Number of the last committed load; 0 before the first."""
        return max((int(n[:-5]) for n in self._names(f"{self.root}/manifest") if n.endswith(".json")), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        g = self.generation() if generation is None else generation
        if not g:
            return {"generation": 0, "n_buckets": getattr(self, "n_buckets", DEFAULT_BUCKETS), "tables": {t: {} for t in SCHEMAS}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{g:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Create the manifest's file, whole or not at all."""
        folder, g = f"{self.root}/manifest", manifest["generation"]
        draft, final = self._path(f"{folder}/draft-{uuid.uuid4().hex}"), self._path(f"{folder}/{g:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another load has committed generation {g}; repeat this one")

    # --- reading
    def table(self, name: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table as of the manifest; of some buckets alone, if given."""
        gens = (manifest or self.manifest())["tables"][name]
        paths = [f"{self.root}/{name}/gen={g}/bucket={b}" for b, g in gens.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def bucket(self, diff_id: str) -> int:
        one = self.spark.range(1).select(bucket_of(F.lit(diff_id), self.n_buckets))
        return one.first()[0]

    def _of(self, name: str, diff_id: str) -> DataFrame:
        return self.table(name, [self.bucket(diff_id)]).where(F.col("diff_id") == diff_id)

    def current(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The registry's newest readable version of each diff."""
        rows = self.table("registry", buckets, manifest)
        fields = [c for c in rows.columns if c != "diff_id"]
        newest = rows.where("status <> 'unreadable'").groupBy("diff_id").agg(F.max_by(F.struct(*fields), "version").alias("m"))
        return newest.select("diff_id", "m.*")

    def list_chunks(self, diff_id: str | None = None) -> DataFrame:
        t = self.table("chunks") if diff_id is None else self._of("chunks", diff_id)
        return t.select("diff_id", "chunk", "files", "lines", summary_col().alias("summary"), "parent_file", "sub_chunk_index")

    def get_chunk(self, diff_id: str, chunk_number: int, include_context: bool = True) -> str:
        """The text of one chunk; ``ValueError`` with the reason if there is none."""
        check_chunk_number(chunk_number)
        stats = self._of("diff_stats", diff_id)
        hit = render(self._of("chunks", diff_id).where(F.col("chunk") == chunk_number), stats, include_context).collect()
        if hit:
            return hit[0].text
        known = self._of("registry", diff_id).orderBy(F.desc("version")).limit(1).collect()
        if not known:
            raise ValueError(f"Diff not loaded: {diff_id}")
        if known[0].status != "ok":
            raise ValueError(known[0].error or ERRORS[known[0].status])
        raise ValueError(f"Chunk {chunk_number} not found. Available chunks: 1-{stats.first().chunks_count}")

    def get_chunks(self, requests: DataFrame) -> DataFrame:
        """F3 in bulk: ``requests(diff_id, chunk)`` -> ``(diff_id, chunk, content, error)``, a row for each request."""
        asked = requests.select("diff_id", F.col("chunk").cast("bigint").alias("chunk")).distinct()
        texts = self.table("chunks").select("diff_id", "chunk", "content")
        state = self.current().select("diff_id", "status").join(self.table("diff_stats").select("diff_id", "chunks_count"), "diff_id", "left")
        x = asked.join(texts, ["diff_id", "chunk"], "left").join(state, "diff_id", "left")
        number = F.col("chunk").cast("string")
        error = (F.when(F.col("content").isNotNull(), None)
                 .when(F.col("chunk").isNull() | (F.col("chunk") <= 0), F.lit("chunk_number must be a positive integer"))
                 .when(F.col("status").isNull(), F.concat(F.lit("Diff not loaded: "), F.coalesce("diff_id", F.lit(""))))
                 .when(F.col("status") != "ok", F.try_element_at(_errors(), F.col("status")))
                 .otherwise(F.concat(F.lit("Chunk "), number, F.lit(" not found. Available chunks: 1-"), F.coalesce("chunks_count", F.lit(0)).cast("string"))))
        return x.select("diff_id", "chunk", "content", error.alias("error"))

    def find_chunks(self, diff_id: str, pattern: str) -> DataFrame:
        t = self._of("chunk_files", diff_id).where(glob_match("path", check_pattern(pattern)))
        return t.select("chunk").distinct().orderBy("chunk")

    def sessions(self) -> DataFrame:
        """D6 by diff: ``(diff_id, chunks, files, total_lines)`` of the diffs with chunks."""
        return self.table("diff_stats").select("diff_id", F.col("chunks_count").alias("chunks"), F.col("total_files").alias("files"), "total_lines")

    # --- loading
    def load(self, diffs: DataFrame, options: LoadOptions | None = None) -> int:
        """Load ``diffs(diff_id, content [, content_key, modification_time, status, error])``; returns the generation.

        Rows whose ``status`` is given ('unreadable', 'empty', ...) are registered with it and not parsed; an
        unreadable version leaves the chunks of the one before in place. Without a modification time every load
        counts as newer than the last.
        """
        options = options or LoadOptions()
        before = self.manifest()
        g = before["generation"] + 1
        diffs = _with_defaults(diffs)
        facts = F.struct("modification_time", "content_key", "status", "error")
        incoming = diffs.groupBy("diff_id").agg(F.max(facts).alias("m")).select("diff_id", "m.*")
        rows = self.table("registry", manifest=before).groupBy("diff_id").agg(
            F.max("version").alias("last"), F.max_by(F.struct("content_key", "options", "modification_time"), "version").alias("old"))
        x = incoming.join(rows, "diff_id", "left")
        same = F.col("old.content_key").eqNullSafe(F.col("content_key")) & (F.col("old.options") == options_text(options))
        stale = F.coalesce(F.col("modification_time") < F.col("old.modification_time"), F.lit(False))
        wanted = x.where(F.col("last").isNull() | (~same & ~stale))
        wanted = wanted.select(*incoming.columns, (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("version"),
                               bucket_of("diff_id", self.n_buckets).alias("bucket")).checkpoint()
        n, touched = wanted.agg(F.count("*"), F.collect_set("bucket")).first()  # at most n_buckets numbers
        if not n:
            return before["generation"]
        small = F.broadcast if n <= BROADCAST_IDS else lambda df: df

        # the texts of the changed diffs are read several times: written once, sorted out of all that landed
        ids = wanted.where("status is null").select("diff_id", F.col("content_key").alias("k"), F.col("modification_time").alias("t"))
        on = [F.col("d.diff_id") == F.col("w.diff_id"), F.col("content_key") == F.col("k"), F.col("modification_time").eqNullSafe(F.col("t"))]
        todo = diffs.where("status is null").alias("d").join(small(ids).alias("w"), on).select("d.diff_id", "content")
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        todo.repartition("diff_id").dropDuplicates(["diff_id"]).write.parquet(staging)
        corpus = DiffCorpus(self.spark.read.schema("diff_id string, content string").parquet(staging).repartition("diff_id"), options)
        corpus.persist(sections=False)
        try:
            said = wanted.drop("bucket").join(corpus.status().withColumnRenamed("status", "parsed"), "diff_id", "left")
            outcome = F.coalesce("status", "parsed")
            registry = said.select("diff_id", "version", "content_key", F.lit(options_text(options)).alias("options"), "modification_time",
                                   outcome.alias("status"), F.coalesce("error", F.try_element_at(_errors(), outcome)).alias("error"), F.lit(g).cast("bigint").alias("generation"))
            new = {"registry": registry, "chunks": corpus.chunks.select(*CHUNK_COLUMNS), "chunk_files": chunk_files(corpus.chunk_meta).distinct(),
                   "diff_stats": corpus.stats}
            replaced = small(wanted.where("status is null or status <> 'unreadable'").select("diff_id"))
            after = {"generation": g, "n_buckets": self.n_buckets, "tables": {}}
            for name, rows in new.items():
                old = self.table(name, touched, before)
                old = old if name == "registry" else old.join(replaced, "diff_id", "left_anti")
                self._write(name, g, old.unionByName(rows))
                # a bucket may have lost all its rows; folders of a failed attempt may lie beside
                written = {x[7:] for x in self._names(f"{self.root}/{name}/gen={g}") if x.startswith("bucket=")} & set(map(str, touched))
                kept = {b: v for b, v in before["tables"][name].items() if int(b) not in touched}
                after["tables"][name] = kept | {b: g for b in sorted(written, key=int)}
            self._commit(after)
        finally:
            corpus.unpersist()
            self._fs.delete(self._path(staging), True)
        return g

    def sync(self, path: str, options: LoadOptions | None = None, glob: str | None = "*.diff", recursive: bool = False) -> int:
        """Load the files under ``path`` that are new or whose time has changed since they were registered.

        Finds edits in place, which a file stream does not report. Files are listed, not opened, to find the changed
        ones; a few of these are read by name, many by a scan of the folder.
        """
        check_path(self.spark, path)
        listed = list_files(_binary(self.spark, path, glob if _is_folder(self.spark, path) else None, recursive))
        known = self.table("registry").groupBy("diff_id").agg(F.max_by(F.struct("modification_time", "options"), "version").alias("old"))
        same = F.col("old.modification_time").eqNullSafe(F.col("modification_time")) & (F.col("old.options") == options_text(options or LoadOptions()))
        changed = listed.join(known, "diff_id", "left").where(F.col("old").isNull() | ~same).select("diff_id").checkpoint()
        some = [r.diff_id for r in changed.limit(NAMED_FILES + 1).collect()]
        if not some:
            return self.generation()
        if len(some) <= NAMED_FILES:
            return self.load(read_diff_files(self.spark, [escaped(p) for p in some], None), options)
        return self.load(read_diff_files(self.spark, path, glob, recursive).join(changed, "diff_id", "left_semi"), options)

    def _write(self, name: str, g: int, rows: DataFrame) -> None:
        x = rows.withColumn("bucket", bucket_of("diff_id", self.n_buckets)).hint("rebalance", "bucket")
        (x.sortWithinPartitions("bucket", *SORT[name]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("parquet.bloom.filter.enabled#diff_id", "true").partitionBy("bucket").parquet(f"{self.root}/{name}/gen={g}"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went."""
        last = self.generation()
        manifests = [self.manifest(g) for g in range(max(1, last - keep + 1), last + 1)]
        gone = 0
        for name in SCHEMAS:
            used = {(int(g), b) for m in manifests for b, g in m["tables"][name].items()}
            for gen in self._names(f"{self.root}/{name}"):
                if not gen.startswith("gen=") or int(gen[4:]) > last:  # a load under way
                    continue
                for bucket in self._names(f"{self.root}/{name}/{gen}"):
                    if bucket.startswith("bucket=") and (int(gen[4:]), bucket[7:]) not in used:
                        gone += bool(self._fs.delete(self._path(f"{self.root}/{name}/{gen}/{bucket}"), True))
        for g in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.root}/manifest/{g:012d}.json"), False)
        return gone


def _errors():
    """The registry's error text of each status, as a map."""
    return F.create_map(*[F.lit(v) for kv in ERRORS.items() for v in kv])


def _with_defaults(diffs: DataFrame) -> DataFrame:
    """The columns ``load`` works on; a null key comes from the content."""
    have = set(diffs.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    time = F.col("modification_time").cast("timestamp") if "modification_time" in have else F.lit(None).cast("timestamp")
    return diffs.where("diff_id is not null").select(
        "diff_id", "content", F.coalesce(text("content_key"), content_key("diff_id", F.coalesce("content", F.lit("")))).alias("content_key"),
        time.alias("modification_time"), text("status").alias("status"), text("error").alias("error"))
