"""Independent DuckDB SQL for every registered query (the correctness oracle).

Deliberately a different algorithm from the Spark plan: sections come from a
running count of header lines over a line table (not a regex split), and the
packing and hunk-split rules run as row-by-row recursive CTEs (not folds).
Globs use DuckDB's own GLOB operator.
"""

from __future__ import annotations

# one diff per (documents.source, doc_id // 1000); see patchloom.sources.corpus for the recipe
CORPUS = r"""
doc_lines AS (
  SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS diff_id, source, doc_id, lang,
         unnest(string_split(text, chr(10))) AS txt,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
),
body_in AS (
  SELECT diff_id, source, CASE WHEN lang = 'en' THEN 'en' ELSE CAST(doc_id AS VARCHAR) END AS skey, doc_id, pos, txt
  FROM doc_lines
),
body AS (
  SELECT diff_id, source, skey, txt,
         min(doc_id) OVER (PARTITION BY diff_id, skey) AS d,
         row_number() OVER (PARTITION BY diff_id, skey ORDER BY doc_id, pos) - 1 AS i
  FROM body_in
),
fsec AS (
  SELECT DISTINCT diff_id, source, skey, d,
         CASE WHEN skey = 'en' THEN 99 ELSE d % 12 END AS k,
         CAST(substring(source, 4) AS INTEGER) AS sn
  FROM body
),
fsecp AS (
  SELECT *,
    CASE WHEN k <> 99 THEN 8 WHEN sn % 3 = 0 THEN 24 WHEN sn % 3 = 1 THEN 100000 ELSE 8 END AS hl,
    CASE k WHEN 0 THEN 'src/old/f' || d || '.py' WHEN 1 THEN 'dist/b' || d || '.js'
      WHEN 2 THEN 'pkg/p' || d || '.lock' WHEN 3 THEN 'Assets/X' || d || '.MIN.CSS'
      WHEN 4 THEN 'docs/d' || d || '.md' WHEN 5 THEN 'img/i' || d || '.png'
      WHEN 6 THEN 'src/.DS_Store' WHEN 7 THEN 'tests/t' || d || '_test.go'
      WHEN 8 THEN 'src/common/shared.js' WHEN 9 THEN 'sp ace' || d || '.txt'
      WHEN 10 THEN 'lib/a b/' || d || '.txt' WHEN 11 THEN 'src/k' || d || '.ts'
      ELSE 'src/big/' || source || '.c' END AS pa
  FROM fsec
),
fsecq AS (
  SELECT *, CASE WHEN k = 0 THEN 'src/new/f' || d || '.py' ELSE pa END AS pb FROM fsecp
),
fx_lines AS (
  SELECT diff_id, -1 AS d, -2 AS seq, 'commit ' || diff_id AS line FROM fsec GROUP BY diff_id
  UNION ALL SELECT diff_id, -1, -1, '' FROM fsec GROUP BY diff_id
  UNION ALL SELECT diff_id, d, 0, CASE WHEN k = 9 THEN 'diff --git "a/' || pa || '" "b/' || pb || '"'
                                 ELSE 'diff --git a/' || pa || ' b/' || pb END FROM fsecq
  UNION ALL SELECT diff_id, d, 1, 'index ' || lpad(CAST(d AS VARCHAR), 7, '0') || '..' || lpad(CAST(d + 1 AS VARCHAR), 7, '0') || ' 100644' FROM fsecq
  UNION ALL SELECT diff_id, d, 2, '--- a/' || pa FROM fsecq WHERE k NOT IN (5, 11)
  UNION ALL SELECT diff_id, d, 3, '+++ b/' || pb FROM fsecq WHERE k NOT IN (5, 11)
  UNION ALL SELECT diff_id, d, 4, 'Binary files a/' || pa || ' and b/' || pb || ' differ' FROM fsecq WHERE k = 5
  UNION ALL SELECT b.diff_id, b.d, 10 + 2 * b.i, '@@ -' || (b.i + 1) || ',' || s.hl || ' +' || (b.i + 1) || ',' || s.hl || ' @@'
    FROM body b JOIN fsecq s USING (diff_id, skey) WHERE s.k <> 5 AND b.i % s.hl = 0
  UNION ALL SELECT b.diff_id, b.d, 11 + 2 * b.i,
    CASE WHEN s.k = 4 THEN (CASE WHEN b.i % 3 = 0 THEN '+  ' ELSE ' ' || b.txt END)
         WHEN b.i % 17 = 16 THEN '--- ' || b.txt
         ELSE (CASE b.i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END) || (CASE WHEN b.i % 11 = 5 THEN '' ELSE b.txt END) END
    FROM body b JOIN fsecq s USING (diff_id, skey) WHERE s.k <> 5
  UNION ALL SELECT diff_id, d, 1000000000000, '' FROM fsecq WHERE d % 2 = 0
),
diffs AS (
  SELECT diff_id, string_agg(line, chr(10) ORDER BY d, seq) AS content FROM fx_lines GROUP BY diff_id
)"""

# --- fixed values (must equal the tool's): blank-test characters, diff syntax, generated markers ---
# Python str.strip() whitespace, written out for RE2
NB = r"[^\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HEADER = r"^diff --git a/(.*) b/(.*)$"
# plain substrings of the lower-cased path
GENERATED = (".lock", ".min.js", ".min.css", ".map", "package-lock.json", "yarn.lock", "Pipfile.lock", ".pyc",
             ".pyo", "__pycache__", "node_modules/", "dist/", "build/", ".git/", ".DS_Store", "Thumbs.db")

LINES = rf"""
lines AS (
  SELECT diff_id, ln - 1 AS ln, line FROM (
    SELECT diff_id, unnest(string_split_regex(t, '\r\n|\r|\n')) AS line,
           generate_subscripts(string_split_regex(t, '\r\n|\r|\n'), 1) AS ln
    FROM (SELECT diff_id, regexp_replace(content, '(\r\n|\r|\n)$', '') AS t FROM diffs WHERE content <> '')
  )
),
sl AS (
  SELECT diff_id, ln, line,
    sum(CASE WHEN regexp_matches(line, '{HEADER}') THEN 1 ELSE 0 END)
      OVER (PARTITION BY diff_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS sec
  FROM lines
),
secl AS (
  SELECT diff_id, CAST(sec AS BIGINT) AS sec, ln - min(ln) OVER (PARTITION BY diff_id, sec) AS i, line,
         regexp_matches(line, '{NB}') AS nb, regexp_matches(line, '{HUNK}') AS hk
  FROM sl WHERE sec > 0
),
secm AS (
  SELECT diff_id, sec,
     max(CASE WHEN i = 0 THEN regexp_extract(line, '{HEADER}', 1) END) AS path_a,
     max(CASE WHEN i = 0 THEN regexp_extract(line, '{HEADER}', 2) END) AS path_b,
     count(*) FILTER (WHERE nb) AS n_lines,
     count(*) AS n_raw,
     min(i) FILTER (WHERE hk) AS header_len,
     NOT bool_or(regexp_matches(line, '^[+-]') AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---')
                 AND regexp_matches(substring(line, 2), '{NB}')) AS is_trivial,
     string_agg(line, chr(10) ORDER BY i) AS text
  FROM secl GROUP BY diff_id, sec
),
secs AS (
  SELECT *, CASE WHEN path_a = path_b THEN [path_a] ELSE [path_a, path_b] END AS files,
         ({' OR '.join(f"contains(lower(path_a), '{g}') OR contains(lower(path_b), '{g}')" for g in GENERATED)}) AS is_generated
  FROM secm
)"""


def _any_glob(patterns) -> str:
    return "(" + " OR ".join(f"path_a GLOB '{p}' OR path_b GLOB '{p}'" for p in patterns) + ")"


def kept_cte(skip_trivial=True, skip_generated=True, include=(), exclude=()) -> str:
    reason = "CASE"
    if skip_trivial:
        reason += " WHEN is_trivial THEN 'trivial'"
    if skip_generated:
        reason += " WHEN is_generated THEN 'generated'"
    if exclude:
        reason += f" WHEN {_any_glob(exclude)} THEN 'excluded'"
    if include:
        reason += f" WHEN NOT {_any_glob(include)} THEN 'not_included'"
    reason += " END" if reason != "CASE" else " WHEN false THEN '' END"
    return f"""
reasons AS (SELECT *, {reason} AS drop_reason FROM secs),
kept AS (SELECT * FROM reasons WHERE drop_reason IS NULL)"""


def chunk_ctes(m: int) -> str:
    t = f"greatest({m} * 0.8, 200.0)"
    # split step as a chain of subqueries over (previous state) x (next body line)
    def step(src: str) -> str:
        return f"""
      SELECT diff_id, sec, bi, h,
             CASE WHEN back THEN lh2 WHEN forced THEN bi + 1 ELSE s1 END AS st,
             CASE WHEN back THEN nl2 WHEN forced THEN 0 ELSE c2 END AS c,
             CASE WHEN forced THEN -1 ELSE lh2 END AS lh,
             nl2 AS nl,
             CASE WHEN a THEN bi END AS cut_a,
             CASE WHEN back THEN lh2 WHEN forced THEN bi + 1 END AS cut_c
      FROM (SELECT *, full_ AND lh2 > s1 AS back, full_ AND NOT (lh2 > s1) AS forced
        FROM (SELECT *, c2 + h >= {m} AS full_
          FROM (SELECT *, CASE WHEN hk THEN bi ELSE lh1 END AS lh2,
                       (CASE WHEN hk THEN 0 ELSE nl0 END) + CASE WHEN nb THEN 1 ELSE 0 END AS nl2,
                       c1 + CASE WHEN nb THEN 1 ELSE 0 END AS c2
            FROM (SELECT *, CASE WHEN a THEN bi ELSE s0 END AS s1, CASE WHEN a THEN 0 ELSE c0 END AS c1,
                         CASE WHEN a THEN -1 ELSE lh0 END AS lh1
              FROM (SELECT *, hk AND bi > s0 AND c0 + h >= {t} AS a FROM ({src}) z0) z1) z2) z3) z4) z5"""

    base = "SELECT diff_id, sec, bi, h, hk, nb, 0 AS s0, 0 AS c0, -1 AS lh0, 0 AS nl0 FROM bl WHERE bi = 0"
    rec = ("SELECT bl.diff_id, bl.sec, bl.bi, bl.h, bl.hk, bl.nb, sp.st AS s0, sp.c AS c0, sp.lh AS lh0, sp.nl AS nl0 "
           "FROM sp JOIN bl ON bl.diff_id = sp.diff_id AND bl.sec = sp.sec AND bl.bi = sp.bi + 1")
    return f"""
kn AS (
  SELECT diff_id, sec, n_lines, n_lines > {m} AS big,
         row_number() OVER (PARTITION BY diff_id ORDER BY sec) AS rn
  FROM kept
),
pk(diff_id, rn, sec, cur, big, slot) AS (
  SELECT diff_id, rn, sec, n_lines, big, 1 FROM kn WHERE rn = 1
  UNION ALL
  SELECT kn.diff_id, kn.rn, kn.sec,
         CASE WHEN kn.big OR pk.big OR pk.cur + kn.n_lines > {m} THEN kn.n_lines ELSE pk.cur + kn.n_lines END,
         kn.big,
         pk.slot + CASE WHEN kn.big OR pk.big OR pk.cur + kn.n_lines > {m} THEN 1 ELSE 0 END
  FROM pk JOIN kn ON kn.diff_id = pk.diff_id AND kn.rn = pk.rn + 1
),
bigsec AS (
  SELECT k.*, p.slot FROM kept k JOIN pk p USING (diff_id, sec) WHERE k.n_lines > {m}
),
bl AS (
  SELECT l.diff_id, l.sec, l.i - s.header_len AS bi, l.hk, l.nb, s.header_len AS h
  FROM secl l JOIN bigsec s USING (diff_id, sec)
  WHERE s.header_len IS NOT NULL AND l.i >= s.header_len
),
sp(diff_id, sec, bi, h, st, c, lh, nl, cut_a, cut_c) AS (
  {step(base)}
  UNION ALL
  {step(rec)}
),
cuts AS (
  SELECT DISTINCT diff_id, sec, pos FROM (
    SELECT diff_id, sec, cut_a AS pos FROM sp WHERE cut_a IS NOT NULL
    UNION ALL SELECT diff_id, sec, cut_c FROM sp WHERE cut_c IS NOT NULL)
),
body_piece AS (
  SELECT bl.diff_id, bl.sec, bl.bi, bl.h,
         1 + (SELECT count(*) FROM cuts c WHERE c.diff_id = bl.diff_id AND c.sec = bl.sec AND c.pos <= bl.bi) AS piece
  FROM bl
),
piece_lines AS (
  SELECT p.diff_id, p.sec, p.piece, l.i, l.line, l.nb
  FROM body_piece p JOIN secl l ON l.diff_id = p.diff_id AND l.sec = p.sec AND l.i = p.bi + p.h
  UNION ALL
  SELECT q.diff_id, q.sec, q.piece, l.i, l.line, l.nb
  FROM (SELECT DISTINCT diff_id, sec, piece, h FROM body_piece) q
  JOIN secl l ON l.diff_id = q.diff_id AND l.sec = q.sec AND l.i < q.h
),
pieces AS (
  SELECT diff_id, sec, piece, count(*) FILTER (WHERE nb) AS lines, string_agg(line, chr(10) ORDER BY i) AS content
  FROM piece_lines GROUP BY diff_id, sec, piece
  UNION ALL
  SELECT diff_id, sec, 1, n_lines, text FROM bigsec WHERE header_len IS NULL
),
sub_chunks AS (
  SELECT p.diff_id, p.sec, b.slot, p.piece AS sub, p.lines, p.content, b.files, b.path_a, b.path_b,
         CASE WHEN b.path_a = b.path_b THEN b.path_a ELSE '2 files' END AS parent_file,
         CASE WHEN count(*) OVER (PARTITION BY p.diff_id, p.sec) > 1 THEN p.piece END AS sub_chunk_index
  FROM pieces p JOIN bigsec b USING (diff_id, sec)
),
small_files AS (
  SELECT diff_id, slot, f, min(key) AS key FROM (
    SELECT k.diff_id, p.slot, k.path_a AS f, k.sec * 10 + 1 AS key FROM kept k JOIN pk p USING (diff_id, sec) WHERE k.n_lines <= {m}
    UNION ALL
    SELECT k.diff_id, p.slot, k.path_b, k.sec * 10 + 2 FROM kept k JOIN pk p USING (diff_id, sec) WHERE k.n_lines <= {m}
  ) GROUP BY diff_id, slot, f
),
small_chunks AS (
  SELECT k.diff_id, p.slot, 0 AS sub, sum(k.n_lines) AS lines, string_agg(k.text, chr(10) || chr(10) ORDER BY k.sec) AS content
  FROM kept k JOIN pk p USING (diff_id, sec) WHERE k.n_lines <= {m} GROUP BY k.diff_id, p.slot
),
all_chunks AS (
  SELECT c.diff_id, c.slot, c.sub, c.lines, c.content, f.files, f.n_files,
         CAST(NULL AS VARCHAR) AS parent_file, CAST(NULL AS BIGINT) AS sub_chunk_index
  FROM small_chunks c JOIN (SELECT diff_id, slot, string_agg(f, ', ' ORDER BY key) AS files, count(*) AS n_files
                            FROM small_files GROUP BY diff_id, slot) f USING (diff_id, slot)
  UNION ALL
  SELECT diff_id, slot, sub, lines, content, array_to_string(files, ', '), len(files), parent_file, sub_chunk_index
  FROM sub_chunks
),
chunks AS (
  SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY slot, sub) AS chunk,
         CASE WHEN parent_file IS NOT NULL AND sub_chunk_index IS NOT NULL
              THEN parent_file || ' (part ' || sub_chunk_index || '), ' || lines || ' lines'
              ELSE n_files || ' files, ' || lines || ' lines' END AS summary
  FROM all_chunks
),
chunk_paths AS (
  SELECT DISTINCT c.diff_id, c.chunk, s.path FROM chunks c
  JOIN (SELECT diff_id, slot, f AS path FROM small_files
        UNION ALL SELECT diff_id, slot, path_a FROM sub_chunks UNION ALL SELECT diff_id, slot, path_b FROM sub_chunks) s
    ON s.diff_id = c.diff_id AND s.slot = c.slot
),
stats AS (
  SELECT c.diff_id, c.total_lines, c.chunks_count, f.total_files FROM
    (SELECT diff_id, sum(lines) AS total_lines, count(*) AS chunks_count FROM chunks GROUP BY diff_id) c
    JOIN (SELECT diff_id, count(DISTINCT path) AS total_files FROM chunk_paths GROUP BY diff_id) f USING (diff_id)
)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts)


def base(*extra: str) -> str:
    return with_(CORPUS, LINES, *extra)


def chunks_sql(m: int, body: str, **filters) -> str:
    return with_(CORPUS, LINES, kept_cte(**filters), chunk_ctes(m)) + "\n" + body
