"""``DiffCorpus``: the load -> filter -> chunk -> index plan over a table of diffs."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import chunks as C
from patchloom.operators import filters as FL
from patchloom.operators import lookup as L
from patchloom.operators import sections as S
from patchloom.operators.pack import DEFAULT_MAX_FOLD_ITEMS
from patchloom.options import LoadOptions, check_chunk_number, check_pattern


class DiffCorpus:
    """All tables of a corpus of diffs, built lazily from ``diffs(diff_id, content)``.

    Nothing runs until an action. Facts (sections, chunk list, statistics) are
    derived without text past the first row-wise step; ``chunks`` adds the texts,
    cut out of the diffs by a join on ``diff_id``. ``persist()`` keeps the facts
    for repeated lookups (recomputable from lineage), not the texts.
    """

    def __init__(self, diffs: DataFrame, options: LoadOptions | None = None,
                 max_fold_items: int = DEFAULT_MAX_FOLD_ITEMS, cache_kept: bool = True):
        self.diffs = diffs
        self.options = options or LoadOptions()
        self.max_fold_items = max_fold_items  # of the line regime; a row's sections are always folded
        self.cache_kept = cache_kept
        self._persisted: list[DataFrame] = []

    @classmethod
    def from_files(cls, spark, path: str, options: LoadOptions | None = None, glob: str | None = "*.diff",
                   **kw) -> "DiffCorpus":
        """Load every diff file under ``path`` (one row per file, keyed by its path)."""
        from patchloom.sources.files import read_diff_files
        return cls(read_diff_files(spark, path, glob=glob), options, **kw)

    @cached_property
    def sections(self) -> DataFrame:
        return S.sections(self.diffs)

    @cached_property
    def filtered(self) -> DataFrame:
        return FL.with_filters(self.sections, self.options)

    @cached_property
    def kept(self) -> DataFrame:
        """Sections that pass the filters, with their text."""
        return self.filtered.where(F.col("drop_reason").isNull()).drop("drop_reason")

    @cached_property
    def facts(self) -> DataFrame:
        """The kept sections without text; oversized ones with the bounds of their pieces."""
        return C.section_facts(self.kept, self.options.max_chunk_lines)

    @cached_property
    def chunk_list(self) -> DataFrame:
        return C.chunk_list(C.slots_of(self.facts, self.options.max_chunk_lines))

    @cached_property
    def chunk_meta(self) -> DataFrame:
        """Chunks without content."""
        return self.chunk_list.select(*C.CHUNK_COLUMNS[:-1])

    @cached_property
    def chunks(self) -> DataFrame:
        return C.chunk_texts(self.diffs, self.chunk_list)

    @cached_property
    def stats(self) -> DataFrame:
        return C.diff_stats(self.chunk_meta)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, sections: bool = True) -> "DiffCorpus":
        """Keep the chunk list and the section facts, both without text."""
        names = ["section_index", "chunk_list"] if sections else ["chunk_list"]
        for name in names:
            self.__dict__[name] = getattr(self, name).persist(level)
            self._persisted.append(self.__dict__[name])
        for name in ("chunk_meta", "chunks", "stats"):
            self.__dict__.pop(name, None)
        return self

    @cached_property
    def section_index(self) -> DataFrame:
        """All sections without their text, with the reason why a section is dropped."""
        return self.filtered.drop("text")

    def unpersist(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted.clear()

    # --- the reference's four questions, for every diff at once -----------
    def overview(self) -> DataFrame:
        return L.overview(self.stats)

    def list_chunks(self) -> DataFrame:
        return L.list_chunks(self.chunk_meta)

    def get_chunk(self, diff_id: str, chunk_number: int, include_context: bool = True) -> DataFrame:
        check_chunk_number(chunk_number)
        hit = self._chunk(diff_id, chunk_number)
        return L.render(hit, self.stats.where(F.col("diff_id") == diff_id), include_context)

    def _chunk(self, diff_id: str, chunk_number: int) -> DataFrame:
        listed = self.chunk_list.where((F.col("diff_id") == diff_id) & (F.col("chunk") == chunk_number))
        return C.chunk_texts(self.diffs.where(F.col("diff_id") == diff_id), listed)

    def find_chunks(self, pattern: str) -> DataFrame:
        return L.find_chunks(self.chunk_meta, check_pattern(pattern))

    def status(self) -> DataFrame:
        return L.diff_status(self.diffs, self.section_index, self.chunk_meta)


class FileCorpus:
    """Diff files of any length: rows for those that fit in one, the line table for the others, one set of tables."""

    def __init__(self, rows: DiffCorpus, lines: DiffCorpus | None = None):
        self.rows, self.lines = rows, lines

    def _both(self, get) -> DataFrame:
        return get(self.rows) if self.lines is None else get(self.rows).unionByName(get(self.lines))

    @property
    def chunks(self) -> DataFrame:
        return self._both(lambda c: c.chunks.select(*C.CHUNK_COLUMNS))

    @property
    def chunk_meta(self) -> DataFrame:
        return self._both(lambda c: c.chunk_meta.select(*C.CHUNK_COLUMNS[:-1]))

    @property
    def stats(self) -> DataFrame:
        return self._both(lambda c: c.stats)

    def overview(self) -> DataFrame:
        return L.overview(self.stats)

    def list_chunks(self) -> DataFrame:
        return L.list_chunks(self.chunk_meta)

    def get_chunk(self, diff_id: str, chunk_number: int, include_context: bool = True) -> DataFrame:
        return self._both(lambda c: c.get_chunk(diff_id, chunk_number, include_context))

    def find_chunks(self, pattern: str) -> DataFrame:
        return L.find_chunks(self.chunk_meta, check_pattern(pattern))

    def status(self) -> DataFrame:
        """A row for every file: ok, no_diff_content, all_filtered, empty or unreadable."""
        own = self.rows.status()
        return own if self.lines is None else own.where("status <> 'long'").unionByName(self.lines.status())


def load_path(spark, path: str, options: LoadOptions | None = None, glob: str | None = "*.diff", recursive: bool = False,
              row_bytes: int | None = None) -> FileCorpus:
    """All diff files under ``path``; files of more than ``row_bytes`` bytes are read as line tables."""
    from patchloom.operators.line_table import LineDiffCorpus, read_diff_lines
    from patchloom.sources.files import ROW_BYTES, escaped, read_diff_files

    limit = ROW_BYTES if row_bytes is None else row_bytes
    diffs = read_diff_files(spark, path, glob, recursive, row_bytes=limit)
    # names of files that are long each, so few for the bytes they hold
    long = [r.diff_id for r in diffs.where("status = 'long'").select("diff_id").collect()]
    lines = LineDiffCorpus(read_diff_lines(spark, [escaped(p) for p in long], None), options) if long else None
    return FileCorpus(DiffCorpus(diffs, options), lines)

