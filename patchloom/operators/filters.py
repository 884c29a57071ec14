"""Section filters (C1-C6) as boolean columns, and the reason a section is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.globs import any_glob
from patchloom.options import LoadOptions


def _any_path(patterns) -> Column:
    # a section has one or two paths (path_a == path_b unless renamed)
    return any_glob("path_a", patterns) | any_glob("path_b", patterns)


def include_match(patterns) -> Column:
    """Some file of the section matches some include glob; no patterns -> everything matches."""
    if not patterns:
        return F.lit(True)
    return _any_path(patterns)


def exclude_match(patterns) -> Column:
    """C4: some file of the section matches some exclude glob."""
    if not patterns:
        return F.lit(False)
    return _any_path(patterns)


def drop_reason(opts: LoadOptions) -> Column:
    """First failing check in the reference order; NULL = kept."""
    r = F.lit(None).cast("string")
    checks = []
    if opts.skip_trivial:
        checks.append((F.col("is_trivial"), "trivial"))
    if opts.skip_generated:
        checks.append((F.col("is_generated"), "generated"))
    if opts.exclude_patterns:
        checks.append((exclude_match(opts.exclude_patterns), "excluded"))
    if opts.include_patterns:
        checks.append((~include_match(opts.include_patterns), "not_included"))
    expr = None
    for cond, name in checks:
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return r if expr is None else expr


def with_filters(secs: DataFrame, opts: LoadOptions) -> DataFrame:
    return secs.withColumn("drop_reason", drop_reason(opts))


def kept(secs: DataFrame, opts: LoadOptions) -> DataFrame:
    return with_filters(secs, opts).where(F.col("drop_reason").isNull()).drop("drop_reason")
