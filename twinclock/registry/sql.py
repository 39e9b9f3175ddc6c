"""Common table expressions the SQL twins are put together from."""

INF = "TIMESTAMP '9999-12-31 23:59:59'"
SYS_MAX = "TIMESTAMP '2106-02-07 06:28:15.999999'"

# The window of the order history and its yearly sync steps.
START, END = "1996-01-01 00:00:00", "2001-08-01 00:00:00"
CUTOFFS = ["1997-01-01 00:00:00", "1998-01-01 00:00:00", "1999-01-01 00:00:00",
           "2000-01-01 00:00:00", "2001-01-01 00:00:00", "2001-08-01 00:00:00"]
# A checkpoint is committed one hour after its cut-off.
COMMITS = [c.replace(" 00:", " 01:") for c in CUTOFFS]
CHECKPOINTS = list(zip(CUTOFFS, COMMITS))

EV = """ev AS (
  SELECT o_custkey AS entity, o_orderkey AS rev_id, o_orderdate AS ts,
         CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders)"""

UEV = """uev AS (
  SELECT user_id AS entity, event_id AS rev_id, date_trunc('second', ts) AS ts, event_type AS kind,
         CAST(round(value * 100) AS BIGINT) AS size_bytes
  FROM events)"""

DOC = """doc AS (
  SELECT source AS entity, d.doc_id AS rev_id, TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INTEGER)) AS ts,
         lang, text, coalesce(l.toxic = 1, false) AS hidden, sha1(text) AS sha1,
         CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def timeline(src: str = "ev", name: str = "tl") -> str:
    return f"""{name}_rk AS (
  SELECT entity, rev_id, ts, row_number() OVER (PARTITION BY entity, ts ORDER BY rev_id DESC) AS rn FROM {src}),
{name} AS (
  SELECT entity, rev_id, ts AS valid_from,
         coalesce(lead(ts) OVER (PARTITION BY entity ORDER BY ts), {INF}) AS valid_to
  FROM {name}_rk WHERE rn = 1)"""


def mirror(src: str = "ev", tl: str = "tl", name: str = "mi") -> str:
    return f"""{name} AS (
  SELECT e.*, t.valid_from AS row_start, CASE WHEN t.valid_to = {INF} THEN {SYS_MAX} ELSE t.valid_to END AS row_end
  FROM {tl} t JOIN {src} e USING (entity, rev_id))"""


def window_events(src: str = "ev", name: str = "win") -> str:
    return f"""{name} AS (
  SELECT * FROM {src} WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
  UNION
  SELECT * FROM (SELECT * FROM {src} WHERE ts <= TIMESTAMP '{START}'
                 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1) b)"""


def step(col: str, cutoffs=CUTOFFS) -> str:
    return "(1 + " + " + ".join(f"CAST({col} > TIMESTAMP '{c}' AS INTEGER)" for c in cutoffs) + ")"


def commit_of(col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN TIMESTAMP '{s}'" for i, s in enumerate(COMMITS, 1)) + " END"


def beliefs(src: str = "ev", name: str = "bel") -> str:
    """Every belief held after syncing ``src`` cut-off by cut-off."""
    return f"""{timeline(f"(SELECT * FROM {src} WHERE ts <= TIMESTAMP '{CUTOFFS[-1]}')", name + "_tl")},
{name}_u AS (
  SELECT entity, rev_id, valid_from, CASE WHEN valid_to < {INF} THEN valid_to END AS nx FROM {name}_tl),
{name}_s AS (
  SELECT *, {step("valid_from")} AS s1, CASE WHEN nx IS NOT NULL THEN {step("nx")} END AS s2 FROM {name}_u),
{name} AS (
  SELECT entity, rev_id, valid_from, CASE WHEN nx IS NULL OR s2 = s1 THEN coalesce(nx, {INF}) ELSE {INF} END AS valid_to,
         {commit_of("s1")} AS row_start, CASE WHEN s2 > s1 THEN {commit_of("s2")} ELSE {SYS_MAX} END AS row_end
  FROM {name}_s
  UNION ALL
  SELECT entity, rev_id, valid_from, nx, {commit_of("s2")}, {SYS_MAX} FROM {name}_s WHERE s2 > s1)"""


def open_end(col: str) -> str:
    return f"CASE WHEN {col} < {INF} THEN {col} END"


# Every event instant of the window, and the second before it, as probes.
PROBES = f"""probes AS (
  SELECT rev_id * 2 + k AS probe_id, entity, ts - to_seconds(k) AS t
  FROM ev CROSS JOIN (VALUES (0), (1)) v(k) WHERE ts >= TIMESTAMP '{START}')"""
