"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` with a DuckDB oracle.

Every query reads the given tables (the diff corpus is derived from
``documents``), runs over whole tables, and aliases every computed column
identically on both sides. Integers are BIGINT, lists are joined with ', '.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import chunks as C
from patchloom.operators import lookup as L
from patchloom.operators import sections as S
from patchloom.operators.pack import pack
from patchloom.options import LoadOptions
from patchloom.plans import oracle as O
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.corpus import load_corpus
from patchloom.sources.files import content_key

MAIN_MAX = 250
SMALL_MAX = 100
INCLUDE_CSV = " *.py, ,tests/* ,*.c"
EXCLUDE_CSV = "src/old/*"
STATUS_INCLUDE = "tests/*,*.md"
FIND_PATTERN = "*.py"
# F6 request list
PATTERNS = ("*.py", "*.c", "src/*", "*test*", "*", "**/*", "*.{js,json}", "[!s]*")
CONV_CAP = 1500
LINEITEM_CAP = 100.0

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def corpus(spark, sf_dir, **opts) -> DiffCorpus:
    return DiffCorpus(load_corpus(spark, sf_dir), LoadOptions(**opts))


def _b(c):
    return F.col(c).cast("bigint").alias(c)


# --- A: sources -----------------------------------------------------------
@register("read_diffs", O.base() + """
SELECT d.diff_id, CAST(length(d.content) AS BIGINT) AS n_chars, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
FROM diffs d LEFT JOIN (SELECT diff_id, count(*) AS n FROM lines GROUP BY diff_id) l USING (diff_id)""")
def read_diffs(spark, sf_dir):
    d = S.normalize(load_corpus(spark, sf_dir))
    n = F.when(F.col("has_lines"), S.T.count_lines("text")).otherwise(F.lit(0))
    return d.select("diff_id", F.length("content").cast("bigint").alias("n_chars"), n.cast("bigint").alias("n_lines"))


@register("diff_lines", O.base() + "\nSELECT diff_id, CAST(ln AS BIGINT) AS ln, line FROM lines")
def diff_lines(spark, sf_dir):
    return S.diff_lines(load_corpus(spark, sf_dir))


@register("content_keys", O.base() + "\nSELECT diff_id, diff_id || '#' || substr(sha256(content), 1, 16) AS key FROM diffs")
def content_keys(spark, sf_dir):
    return load_corpus(spark, sf_dir).select("diff_id", content_key("diff_id", "content").alias("key"))


_REGISTRY_SQL = r"""
keys AS (SELECT diff_id, diff_id || '#' || substr(sha256(content), 1, 16) AS key,
                CAST(regexp_extract(diff_id, '^src(\d+)', 1) AS INTEGER) AS sn FROM diffs),
registry AS (SELECT diff_id, key FROM keys WHERE sn % 2 = 0
             UNION ALL SELECT diff_id, diff_id || '#stale' FROM keys WHERE sn % 4 = 1)"""


@register("changed_diffs", O.base(_REGISTRY_SQL) + """
SELECT diff_id FROM keys k WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.diff_id = k.diff_id AND r.key = k.key)""")
def changed_diffs(spark, sf_dir):
    from patchloom.sources.files import changed
    d = load_corpus(spark, sf_dir)
    keys = d.select("diff_id", content_key("diff_id", "content").alias("key"),
                    F.regexp_extract("diff_id", r"^src(\d+)", 1).cast("int").alias("sn"))
    registry = keys.where("sn % 2 = 0").select("diff_id", "key").unionByName(
        keys.where("sn % 4 = 1").select("diff_id", F.concat("diff_id", F.lit("#stale")).alias("key")))
    return changed(keys.select("diff_id", "key"), registry).select("diff_id")


@register("duplicate_diffs", """
SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_diffs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return docs.groupBy(F.sha2("text", 256).alias("key")).agg(
        F.count("*").cast("bigint").alias("n")).where("n > 1")


# --- A4: the corpus loaded, edited and loaded again ------------------------
_ADDED = "\ndiff --git a/added/{d}.py b/added/{d}.py\n@@ -0,0 +1,2 @@\n+first\n+second"
_EDITED_SQL = (r"CAST(regexp_extract(diff_id, '^src(\d+)', 1) AS INTEGER) % 2 = 1", "'" + _ADDED.replace("\n", "' || chr(10) || '").replace("{d}", "' || diff_id || '") + "'")
_EDITED_CORPUS = (O.CORPUS.rsplit("diffs AS (", 1)[0] + "diffs_before AS (" + O.CORPUS.rsplit("diffs AS (", 1)[1]
                  + f", diffs AS (SELECT diff_id, CASE WHEN {_EDITED_SQL[0]} THEN content || {_EDITED_SQL[1]} ELSE content END AS content FROM diffs_before)")


def _reloaded(spark, sf_dir):
    """A store that loaded the corpus, then edits of the odd sources' diffs, then late arrivals of what it had.

    The corpus is derived and written once; every load reads the written diffs, several times over.
    """
    import datetime
    import uuid

    from patchloom.session import ensure_checkpoint_dir
    from patchloom.sources.versions import CorpusStore

    root = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    store = CorpusStore(spark, root, n_buckets=16)
    at = lambda day: F.lit(datetime.datetime(2024, 1, day)).alias("modification_time")
    load_corpus(spark, sf_dir).write.parquet(f"{root}-corpus")
    first = spark.read.schema("diff_id string, content string").parquet(f"{root}-corpus")
    odd = F.regexp_extract("diff_id", r"^src(\d+)", 1).cast("int") % 2 == 1
    parts = _ADDED.split("{d}")
    added = F.concat(*[x for p in parts for x in (F.lit(p), F.col("diff_id"))][:-1])
    edited = first.where(odd).select("diff_id", F.concat("content", added).alias("content"), at(3))
    options = LoadOptions(max_chunk_lines=MAIN_MAX)
    store.load(first.select("diff_id", "content", at(2)), options)
    store.load(edited, options)
    store.load(first.select("diff_id", "content", at(1)), options)  # older versions: nothing to do
    return store


@register("reload_chunks", O.with_(_EDITED_CORPUS, O.LINES, O.kept_cte(), O.chunk_ctes(MAIN_MAX)) + """
SELECT diff_id, chunk, files, CAST(lines AS BIGINT) AS lines, summary, parent_file, md5(content) AS content_md5 FROM chunks""")
def reload_chunks(spark, sf_dir):
    store = _reloaded(spark, sf_dir)
    texts = store.table("chunks").select("diff_id", "chunk", F.md5("content").alias("content_md5"))
    listed = store.list_chunks().select("diff_id", "chunk", F.array_join("files", ", ").alias("files"), "lines", "summary", "parent_file")
    return listed.join(texts, ["diff_id", "chunk"])


@register("reload_registry", O.with_(_EDITED_CORPUS, O.LINES, O.kept_cte(), O.chunk_ctes(MAIN_MAX)) + """
SELECT b.diff_id, CAST(v.version AS BIGINT) AS version, CAST(v.version AS BIGINT) AS generation,
       b.diff_id || '#' || substr(sha256(CASE WHEN v.version = 1 THEN b.content ELSE d.content END), 1, 16) AS content_key,
       CASE WHEN EXISTS (SELECT 1 FROM chunks c WHERE c.diff_id = b.diff_id) THEN 'ok' ELSE 'all_filtered' END AS status
FROM diffs_before b JOIN diffs d USING (diff_id) JOIN (VALUES (1), (2)) v(version) ON v.version = 1 OR d.content <> b.content""")
def reload_registry(spark, sf_dir):
    return _reloaded(spark, sf_dir).table("registry").select("diff_id", "version", "generation", "content_key", "status")


@register("overview_sessions", O.with_(_EDITED_CORPUS, O.LINES, O.kept_cte(), O.chunk_ctes(MAIN_MAX)) + """
SELECT diff_id, CAST(chunks_count AS BIGINT) AS chunks, CAST(total_files AS BIGINT) AS files, CAST(total_lines AS BIGINT) AS total_lines FROM stats""")
def overview_sessions(spark, sf_dir):
    return _reloaded(spark, sf_dir).sessions()


# --- B: parsing -----------------------------------------------------------
_KIND_SQL = r"""CASE WHEN regexp_matches(line, '^diff --git a/(.*) b/(.*)$') THEN 'header'
  WHEN regexp_matches(line, '^index [a-f0-9]+\.\.[a-f0-9]+') THEN 'index'
  WHEN regexp_matches(line, '^(new|deleted) file mode') THEN 'mode'
  WHEN regexp_matches(line, '^Binary files .* differ$') THEN 'binary'
  WHEN regexp_matches(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@') THEN 'hunk'
  WHEN starts_with(line, '+++') OR starts_with(line, '---') THEN 'meta'
  WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'del'
  WHEN starts_with(line, ' ') THEN 'context' WHEN line = '' THEN 'empty' ELSE 'other' END"""


@register("line_kinds", O.base() + f"\nSELECT diff_id, {_KIND_SQL} AS line_kind, count(*) AS n FROM lines GROUP BY ALL")
def line_kinds(spark, sf_dir):
    return S.line_kind_counts(load_corpus(spark, sf_dir)).select("diff_id", "line_kind", _b("n"))


@register("hunks", O.base() + r"""
SELECT diff_id, sec, row_number() OVER (PARTITION BY diff_id, sec ORDER BY i) AS hunk,
  CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 1) AS BIGINT) AS old_start,
  CAST(coalesce(nullif(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 2), ''), '1') AS BIGINT) AS old_len,
  CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3) AS BIGINT) AS new_start,
  CAST(coalesce(nullif(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 4), ''), '1') AS BIGINT) AS new_len
FROM secl WHERE hk""")
def hunks(spark, sf_dir):
    h = S.hunks(S.sections(load_corpus(spark, sf_dir)))
    return h.select(*[_b(c) if c != "diff_id" else c for c in h.columns])


@register("preamble_lines", O.base() + """
SELECT diff_id, CAST(count(*) FILTER (WHERE sec = 0) AS BIGINT) AS n FROM sl GROUP BY diff_id""")
def preamble_lines(spark, sf_dir):
    return S.preamble_lines(load_corpus(spark, sf_dir))


def _sec_query(name, cols_spark, cols_sql):
    @register(name, O.base() + f"\nSELECT diff_id, CAST(sec AS BIGINT) AS sec, {cols_sql} FROM secs")
    def q(spark, sf_dir):
        s = S.sections(load_corpus(spark, sf_dir))
        return s.select("diff_id", _b("sec"), *cols_spark())
    return q


_sec_query("sections", lambda: [_b("n_raw")], "CAST(n_raw AS BIGINT) AS n_raw")
_sec_query("section_paths", lambda: ["path_a", "path_b", F.array_join("files", ", ").alias("files")],
           "path_a, path_b, array_to_string(files, ', ') AS files")
_sec_query("section_headers", lambda: [_b("header_len")], "CAST(header_len AS BIGINT) AS header_len")
_sec_query("section_content", lambda: [F.md5("text").alias("content_md5")], "md5(text) AS content_md5")
_sec_query("section_line_counts", lambda: [_b("n_lines")], "CAST(n_lines AS BIGINT) AS n_lines")
_sec_query("blank_lines", lambda: [(F.col("n_raw") - F.col("n_lines")).cast("bigint").alias("n_blank")],
           "CAST(n_raw - n_lines AS BIGINT) AS n_blank")
_sec_query("trivial_sections", lambda: ["is_trivial"], "is_trivial")
_sec_query("generated_sections", lambda: ["is_generated"], "is_generated")


# --- C: filters -----------------------------------------------------------
@register("include_filter", O.base() + "\nSELECT diff_id, CAST(sec AS BIGINT) AS sec, "
          + O._any_glob(("*.py", "*.go")) + " AS included FROM secs")
def include_filter(spark, sf_dir):
    from patchloom.operators.filters import include_match
    s = S.sections(load_corpus(spark, sf_dir))
    return s.select("diff_id", _b("sec"), include_match(("*.py", "*.go")).alias("included"))


@register("exclude_filter", O.base() + "\nSELECT diff_id, CAST(sec AS BIGINT) AS sec, "
          + O._any_glob(("src/*",)) + " AS excluded FROM secs")
def exclude_filter(spark, sf_dir):
    from patchloom.operators.filters import exclude_match
    s = S.sections(load_corpus(spark, sf_dir))
    return s.select("diff_id", _b("sec"), exclude_match(("src/*",)).alias("excluded"))


_INC = tuple(p.strip() for p in INCLUDE_CSV.split(",") if p.strip())
_EXC = tuple(p.strip() for p in EXCLUDE_CSV.split(",") if p.strip())


@register("filter_reasons", O.with_(O.CORPUS, O.LINES, O.kept_cte(include=_INC, exclude=_EXC)) + """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, coalesce(drop_reason, 'kept') AS reason FROM reasons""")
def filter_reasons(spark, sf_dir):
    c = DiffCorpus(load_corpus(spark, sf_dir), LoadOptions.from_strings(MAIN_MAX, include_patterns=INCLUDE_CSV,
                                                                         exclude_patterns=EXCLUDE_CSV))
    return c.filtered.select("diff_id", _b("sec"), F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


@register("include_exclude", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, chunk, files, CAST(lines AS BIGINT) AS lines, summary FROM chunks""", include=_INC, exclude=_EXC))
def include_exclude(spark, sf_dir):
    c = DiffCorpus(load_corpus(spark, sf_dir), LoadOptions.from_strings(MAIN_MAX, include_patterns=INCLUDE_CSV,
                                                                         exclude_patterns=EXCLUDE_CSV))
    return c.list_chunks().select("diff_id", "chunk", F.array_join("files", ", ").alias("files"), "lines", "summary")


# --- E: packing and splitting ---------------------------------------------
@register("pack_sections", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, CAST(slot AS BIGINT) AS slot FROM pk"""))
def pack_sections(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    return C.section_slots(c.kept, MAIN_MAX).select("diff_id", _b("sec"), "slot")


def _pack_oracle(table, group, order, weight, cap, rn_order) -> str:
    g = ", ".join(group)
    join_g = " AND ".join(f"i.{c} = p.{c}" for c in group)
    return f"""WITH RECURSIVE items AS (
  SELECT *, {weight} AS w, row_number() OVER (PARTITION BY {g} ORDER BY {rn_order}) AS rn FROM {table}
),
p AS (
  SELECT {g}, rn, w AS cur, w > {cap} AS big, 1 AS slot FROM items WHERE rn = 1
  UNION ALL
  SELECT {", ".join("i." + c for c in group)}, i.rn,
         CASE WHEN i.w > {cap} OR p.big OR p.cur + i.w > {cap} THEN i.w ELSE p.cur + i.w END,
         i.w > {cap},
         p.slot + CASE WHEN i.w > {cap} OR p.big OR p.cur + i.w > {cap} THEN 1 ELSE 0 END
  FROM p JOIN items i ON {join_g} AND i.rn = p.rn + 1
)
SELECT {", ".join(f"i.{c}" for c in group + order)}, CAST(p.slot AS BIGINT) AS slot
FROM items i JOIN p ON {join_g} AND p.rn = i.rn"""


@register("pack_conversations", _pack_oracle("conversations", ["conv_id"], ["turn"], "length(text)", CONV_CAP, "turn"))
def pack_conversations(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", F.length("text").alias("w"))
    return pack(conv, ["conv_id"], ["turn"], "w", CONV_CAP).select("conv_id", "turn", "slot")


@register("pack_lineitem", _pack_oracle("lineitem", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"],
                                        "l_quantity", LINEITEM_CAP, "l_linenumber, l_partkey, l_suppkey, l_quantity"))
def pack_lineitem(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return pack(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", LINEITEM_CAP).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "slot")


def _pack_long_oracle(table, group, items, cap_units, rn_order) -> str:
    """Next-fit over exact prefix sums: each item's next slot by an as-of join, then a walk from slot to slot."""
    g = ", ".join(group)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in group)
    return f"""WITH RECURSIVE items AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {rn_order}) AS rn FROM ({items})),
sums AS (SELECT {g}, rn, u, CAST(sum(u) OVER (PARTITION BY {g} ORDER BY rn) AS HUGEINT) AS p FROM items),
ends AS (SELECT {g}, p, min(rn) AS rn FROM sums GROUP BY {g}, p),
nexts AS MATERIALIZED (SELECT {", ".join("f." + c for c in group)}, f.rn, CASE WHEN f.u > {cap_units} THEN f.rn + 1 ELSE n.rn END AS nx
  FROM sums f ASOF LEFT JOIN ends n ON {on("n", "f")} AND f.p - f.u + {cap_units} < n.p),
opens({g}, rn) AS (
  SELECT {g}, CAST(1 AS BIGINT) FROM items GROUP BY {g}
  UNION ALL
  SELECT {", ".join("o." + c for c in group)}, x.nx FROM opens o JOIN nexts x ON {on("x", "o")} AND x.rn = o.rn WHERE x.nx IS NOT NULL
)
SELECT i.* EXCLUDE (u, rn), CAST(count(o.rn) OVER (PARTITION BY {", ".join("i." + c for c in group)} ORDER BY i.rn) AS BIGINT) AS slot
FROM items i LEFT JOIN opens o ON {on("o", "i")} AND o.rn = i.rn"""


REVENUE_CAP = 2_500_000.0
REVENUE_FOLD = 1_000


@register("pack_revenue", _pack_long_oracle(
    "lineitem", ["l_returnflag", "l_linestatus"], """
  SELECT l_returnflag, l_linestatus, l_shipdate, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue,
         CAST(round(l_extendedprice * (1 - l_discount) * 1000000) AS BIGINT) AS u FROM lineitem""",
    int(REVENUE_CAP * 10**6), "l_shipdate, revenue, l_orderkey, l_linenumber"))
def pack_revenue(spark, sf_dir):
    """Fractional weights, ties on the order key, and groups on both sides of the fold's limit."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return pack(li, ["l_returnflag", "l_linestatus"], ["l_shipdate"], "revenue", REVENUE_CAP, max_fold_items=REVENUE_FOLD)


@register("oversized_sections", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, CAST(n_lines AS BIGINT) AS n_lines FROM bigsec"""))
def oversized_sections(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    return c.kept.where(F.col("n_lines") > MAIN_MAX).select("diff_id", _b("sec"), "n_lines")


def _split_query(name, m):
    @register(name, O.chunks_sql(m, """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, CAST(sub AS BIGINT) AS sub, CAST(lines AS BIGINT) AS lines FROM sub_chunks"""))
    def q(spark, sf_dir):
        from patchloom.operators.split import split_oversized
        c = corpus(spark, sf_dir, max_chunk_lines=m)
        p = split_oversized(c.kept.where(F.col("n_lines") > m), m)
        return p.select("diff_id", _b("sec"), _b("sub"), "lines")
    return q


_split_query("split_sections", MAIN_MAX)
_split_query("split_sections_100", SMALL_MAX)


@register("sub_chunks", O.chunks_sql(SMALL_MAX, """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, CAST(sub AS BIGINT) AS sub, CAST(sub_chunk_index AS BIGINT) AS sub_chunk_index,
       parent_file FROM sub_chunks"""))
def sub_chunks(spark, sf_dir):
    from patchloom.operators.split import split_oversized
    c = corpus(spark, sf_dir, max_chunk_lines=SMALL_MAX)
    p = split_oversized(c.kept.where(F.col("n_lines") > SMALL_MAX), SMALL_MAX)
    return p.select("diff_id", _b("sec"), _b("sub"), _b("sub_chunk_index"), "parent_file")


@register("sub_chunk_content", O.chunks_sql(SMALL_MAX, """
SELECT diff_id, CAST(sec AS BIGINT) AS sec, CAST(sub AS BIGINT) AS sub, md5(content) AS content_md5 FROM sub_chunks"""))
def sub_chunk_content(spark, sf_dir):
    from patchloom.operators.split import split_oversized
    c = corpus(spark, sf_dir, max_chunk_lines=SMALL_MAX)
    p = split_oversized(c.kept.where(F.col("n_lines") > SMALL_MAX), SMALL_MAX)
    return p.select("diff_id", _b("sec"), _b("sub"), F.md5("content").alias("content_md5"))


# --- E6 / F: chunks, listing, lookup ---------------------------------------
_LIST_SQL = """
SELECT diff_id, chunk, files, CAST(lines AS BIGINT) AS lines, summary, parent_file,
       CAST(sub_chunk_index AS BIGINT) AS sub_chunk_index FROM chunks"""


def _list(c: DiffCorpus) -> DataFrame:
    return c.list_chunks().select("diff_id", "chunk", F.array_join("files", ", ").alias("files"), "lines", "summary",
                                  "parent_file", _b("sub_chunk_index"))


@register("list_chunks", O.chunks_sql(MAIN_MAX, _LIST_SQL))
def list_chunks(spark, sf_dir):
    return _list(corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX))


@register("list_chunks_lines", O.chunks_sql(MAIN_MAX, _LIST_SQL))
def list_chunks_lines(spark, sf_dir):
    """The same listing through the line-table path (giant-diff regime)."""
    from patchloom.operators.line_table import LineDiffCorpus, lines_from_diffs
    lc = LineDiffCorpus(lines_from_diffs(load_corpus(spark, sf_dir)), LoadOptions(max_chunk_lines=MAIN_MAX))
    return _list(lc)


def _giant(spark, sf_dir):
    """The corpus as files, read back as section records (byte ranges of giant diffs)."""
    import uuid

    from patchloom.operators.section_records import SectionDiffCorpus, read_records
    from patchloom.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    load_corpus(spark, sf_dir).select("diff_id", S.T.normalized_text("content")).write.partitionBy("diff_id").text(folder)
    name = F.regexp_extract("diff_id", "diff_id=([^/]+)/", 1).alias("diff_id")
    records = read_records(spark, folder, glob=None, recursive=True)
    return SectionDiffCorpus(records.select(name, "blk", "rid", "value"), LoadOptions(max_chunk_lines=MAIN_MAX))


@register("list_chunks_giant", O.chunks_sql(MAIN_MAX, _LIST_SQL))
def list_chunks_giant(spark, sf_dir):
    return _list(_giant(spark, sf_dir))


@register("chunk_content_giant", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, chunk, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS content_len FROM chunks"""))
def chunk_content_giant(spark, sf_dir):
    ch = _giant(spark, sf_dir).chunks
    return ch.select("diff_id", "chunk", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("content_len"))


@register("diff_stats_giant", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, CAST(total_files AS BIGINT) AS total_files, CAST(total_lines AS BIGINT) AS total_lines,
       CAST(chunks_count AS BIGINT) AS chunks_count FROM stats"""))
def diff_stats_giant(spark, sf_dir):
    return _giant(spark, sf_dir).stats


@register("list_chunks_split_parallel", O.chunks_sql(SMALL_MAX, _LIST_SQL))
def list_chunks_split_parallel(spark, sf_dir):
    """Line regime with every oversized section split by the parallel (pointer-doubling) form."""
    from patchloom.operators.line_table import LineDiffCorpus, lines_from_diffs
    lc = LineDiffCorpus(lines_from_diffs(load_corpus(spark, sf_dir)), LoadOptions(max_chunk_lines=SMALL_MAX),
                        max_section_lines=0)
    return _list(lc)


@register("list_chunks_100", O.chunks_sql(SMALL_MAX, _LIST_SQL))
def list_chunks_100(spark, sf_dir):
    return _list(corpus(spark, sf_dir, max_chunk_lines=SMALL_MAX))


@register("list_chunks_default", O.chunks_sql(1000, _LIST_SQL))
def list_chunks_default(spark, sf_dir):
    return _list(corpus(spark, sf_dir))


@register("list_chunks_unfiltered", O.chunks_sql(MAIN_MAX, _LIST_SQL, skip_trivial=False, skip_generated=False))
def list_chunks_unfiltered(spark, sf_dir):
    return _list(corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX, skip_trivial=False, skip_generated=False))


@register("chunk_summaries", O.chunks_sql(MAIN_MAX, "SELECT diff_id, chunk, summary FROM chunks"))
def chunk_summaries(spark, sf_dir):
    return corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).list_chunks().select("diff_id", "chunk", "summary")


@register("chunk_sizes", O.chunks_sql(MAIN_MAX, "SELECT diff_id, chunk, CAST(lines AS BIGINT) AS lines FROM chunks"))
def chunk_sizes(spark, sf_dir):
    return corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).chunk_meta.select("diff_id", "chunk", "lines")


@register("chunk_file_lists", O.chunks_sql(MAIN_MAX, "SELECT diff_id, chunk, files FROM chunks"))
def chunk_file_lists(spark, sf_dir):
    m = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).chunk_meta
    return m.select("diff_id", "chunk", F.array_join("files", ", ").alias("files"))


@register("chunk_content", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, chunk, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS content_len FROM chunks"""))
def chunk_content(spark, sf_dir):
    ch = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).chunks
    return ch.select("diff_id", "chunk", F.md5("content").alias("content_md5"),
                     F.length("content").cast("bigint").alias("content_len"))


@register("chunk_json", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, chunk, '{"chunk":' || chunk || ',"files":' || to_json(string_split(files, ', ')) || ',"lines":' || lines
  || ',"summary":' || to_json(summary) || ',"parent_file":' || coalesce(to_json(parent_file), 'null')
  || ',"sub_chunk_index":' || coalesce(CAST(sub_chunk_index AS VARCHAR), 'null') || '}' AS json FROM chunks"""))
def chunk_json(spark, sf_dir):
    return L.chunk_json(corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).chunk_meta)


def _requests(diffs: DataFrame) -> DataFrame:
    """Chunk 1, 2 and 9999 of every diff (hits and misses)."""
    chunks = F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 9999)])
    return diffs.select("diff_id", F.explode(chunks).alias("chunk"))


_REQ_SQL = "req AS (SELECT diff_id, chunk FROM diffs, (VALUES (1), (2), (9999)) v(chunk))"


@register("get_chunk", O.with_(O.CORPUS, O.LINES, O.kept_cte(), O.chunk_ctes(MAIN_MAX), _REQ_SQL) + """
SELECT c.diff_id, c.chunk, md5(c.content) AS content_md5 FROM chunks c JOIN req r USING (diff_id, chunk)""")
def get_chunk(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    return L.get_chunks(c.chunks, _requests(c.diffs)).select("diff_id", "chunk", F.md5("content").alias("content_md5"))


@register("missing_chunks", O.with_(O.CORPUS, O.LINES, O.kept_cte(), O.chunk_ctes(MAIN_MAX), _REQ_SQL) + """
SELECT r.diff_id, CAST(r.chunk AS BIGINT) AS chunk,
       'Chunk ' || r.chunk || ' not found. Available chunks: 1-' || coalesce(s.chunks_count, 0) AS error
FROM req r LEFT JOIN stats s USING (diff_id)
WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.diff_id = r.diff_id AND c.chunk = r.chunk)""")
def missing_chunks(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    return L.missing_chunks(c.chunk_meta, _requests(c.diffs), c.stats)


@register("render_chunk", O.chunks_sql(MAIN_MAX, """
SELECT c.diff_id, c.chunk, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS text_len FROM (
  SELECT c.*, '=== Chunk ' || c.chunk || ' of ' || s.chunks_count || ' ===' || chr(10) || 'Files: ' || c.files || chr(10)
         || 'Lines: ' || c.lines || chr(10) || repeat('=', 50) || chr(10) || c.content AS t
  FROM chunks c JOIN stats s USING (diff_id)) c"""))
def render_chunk(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    r = L.render(c.chunks, c.stats)
    return r.select("diff_id", "chunk", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_len"))


@register("find_chunks", O.chunks_sql(MAIN_MAX, f"""
SELECT DISTINCT diff_id, chunk FROM chunk_paths WHERE path GLOB '{FIND_PATTERN}'"""))
def find_chunks(spark, sf_dir):
    return corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).find_chunks(FIND_PATTERN)


@register("find_chunks_multi", O.chunks_sql(MAIN_MAX, f"""
SELECT DISTINCT c.diff_id, p.pattern, c.chunk FROM chunk_paths c
JOIN (VALUES {", ".join(f"('{p}')" for p in PATTERNS)}) p(pattern) ON c.path GLOB p.pattern"""))
def find_chunks_multi(spark, sf_dir):
    c = corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX)
    return L.find_chunks_multi(c.chunk_meta, L.patterns_table(spark, PATTERNS))


@register("file_chunk_index", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, path, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY chunk) AS chunks FROM chunk_paths GROUP BY ALL"""))
def file_chunk_index(spark, sf_dir):
    idx = C.file_chunk_index(corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).chunk_meta)
    return idx.select("diff_id", "path", F.array_join("chunks", ",").alias("chunks"))


@register("diff_stats", O.chunks_sql(MAIN_MAX, """
SELECT diff_id, CAST(total_files AS BIGINT) AS total_files, CAST(total_lines AS BIGINT) AS total_lines,
       CAST(chunks_count AS BIGINT) AS chunks_count FROM stats"""))
def diff_stats(spark, sf_dir):
    return corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).stats


@register("corpus_overview", O.chunks_sql(MAIN_MAX, """
SELECT count(*) > 0 AS loaded, CAST(count(*) AS BIGINT) AS total_sessions, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks,
       CAST(coalesce(sum(total_files), 0) AS BIGINT) AS files, CAST(coalesce(sum(total_lines), 0) AS BIGINT) AS total_lines
FROM stats"""))
def corpus_overview(spark, sf_dir):
    return corpus(spark, sf_dir, max_chunk_lines=MAIN_MAX).overview()


_ST_INC = tuple(p for p in STATUS_INCLUDE.split(","))


@register("diff_status", O.chunks_sql(MAIN_MAX, """
SELECT d.diff_id, CASE WHEN NOT EXISTS (SELECT 1 FROM secs s WHERE s.diff_id = d.diff_id) THEN 'no_diff_content'
                       WHEN NOT EXISTS (SELECT 1 FROM chunks c WHERE c.diff_id = d.diff_id) THEN 'all_filtered'
                       ELSE 'ok' END AS status FROM diffs d""", include=_ST_INC))
def diff_status(spark, sf_dir):
    c = DiffCorpus(load_corpus(spark, sf_dir), LoadOptions.from_strings(MAIN_MAX, include_patterns=STATUS_INCLUDE))
    return c.status()


@register("diffstat", O.base() + """
SELECT s.diff_id, s.path_b AS path,
       CAST(count(*) FILTER (WHERE starts_with(l.line, '+') AND NOT starts_with(l.line, '+++')) AS BIGINT) AS added,
       CAST(count(*) FILTER (WHERE starts_with(l.line, '-') AND NOT starts_with(l.line, '---')) AS BIGINT) AS removed
FROM secl l JOIN secs s USING (diff_id, sec) GROUP BY ALL""")
def diffstat(spark, sf_dir):
    return S.diffstat(S.sections(load_corpus(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
