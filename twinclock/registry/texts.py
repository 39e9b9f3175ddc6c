"""Queries on texts: de-duplication, packs, size reports, comparison."""

from pyspark.sql import functions as F

from twinclock.operators import content as G
from twinclock.operators import diff as H
from twinclock.registry.core import query
from twinclock.registry.sql import DOC

MIDDLE = "2020-01-10 00:00:00"
TEXTS = f"""WITH {DOC}, tx AS (SELECT sha1, any_value(text) AS text, max(size_bytes) AS byte_length,
    min(ts) AS first_ts, arg_min(rev_id, (ts, rev_id)) AS first_rev, arg_min(entity, (ts, rev_id)) AS entity FROM doc WHERE NOT hidden GROUP BY sha1)"""


@query("distinct_texts", f"{TEXTS} SELECT sha1, byte_length, first_ts, first_rev, entity, md5(text) AS text_md5 FROM tx")
def _(t):
    return G.distinct_texts(t.documents).withColumn("text_md5", F.md5("text")).drop("text")


# A store in which every exclamation mark was lost: those texts no longer fit their digest.
@query("damaged_texts", f"""{TEXTS} SELECT sha1 FROM tx WHERE text LIKE '%!%'""")
def _(t):
    stored = G.distinct_texts(t.documents).withColumn("text", F.regexp_replace("text", "!", "?"))
    return G.damaged_texts(stored).select("sha1")


# Languages as entities: few and long, so the count bound of 64 acts and the byte bound does not.
BY_LANG = f"""WITH {DOC}, tx AS (SELECT sha1, max(size_bytes) AS byte_length, min(rev_id) AS first_rev, arg_min(lang, rev_id) AS entity
    FROM doc WHERE NOT hidden GROUP BY sha1),
  n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_rev) AS rn FROM tx)"""


def by_language(t):
    return G.distinct_texts(t.documents.withColumn("entity", F.col("lang")))


@query("pack_texts_default", f"""WITH RECURSIVE {BY_LANG.removeprefix('WITH ')}, g AS (
    SELECT entity, sha1, byte_length, rn, CAST(1 AS BIGINT) AS pack, byte_length AS filled, 1 AS texts FROM n WHERE rn = 1
    UNION ALL
    SELECT n.entity, n.sha1, n.byte_length, n.rn, CASE WHEN f THEN pack + 1 ELSE pack END,
           CASE WHEN f THEN n.byte_length ELSE filled + n.byte_length END, CASE WHEN f THEN 1 ELSE texts + 1 END
    FROM (SELECT n.*, g.pack, g.filled, g.texts, g.filled + n.byte_length > 8388608 OR g.texts >= 64 AS f
          FROM g JOIN n ON n.entity = g.entity AND n.rn = g.rn + 1) n)
  SELECT entity, sha1, pack, CAST(filled - byte_length AS BIGINT) AS byte_offset, byte_length FROM g""")
def _(t):
    return G.pack_texts(by_language(t))


@query("pack_texts_by_count", f"""{BY_LANG}, p AS (SELECT *, (rn - 1) // 64 + 1 AS pack FROM n)
  SELECT entity, sha1, pack, CAST(sum(byte_length) OVER (PARTITION BY entity, pack ORDER BY rn) - byte_length AS BIGINT) AS byte_offset, byte_length FROM p""")
def _(t):
    return G.pack_texts(by_language(t), max_bytes=1 << 40)


# Both bounds, against a recursion over the texts of each entity; blocks of 100 texts exercise the cut.
@query("pack_texts", f"""WITH RECURSIVE {BY_LANG.removeprefix('WITH ')}, g AS (
    SELECT entity, sha1, byte_length, rn, CAST(1 AS BIGINT) AS pack, byte_length AS filled, 1 AS texts FROM n WHERE rn = 1
    UNION ALL
    SELECT n.entity, n.sha1, n.byte_length, n.rn, CASE WHEN f THEN pack + 1 ELSE pack END,
           CASE WHEN f THEN n.byte_length ELSE filled + n.byte_length END, CASE WHEN f THEN 1 ELSE texts + 1 END
    FROM (SELECT n.*, g.pack, g.filled, g.texts, g.filled + n.byte_length > 20000 OR g.texts >= 8 AS f
          FROM g JOIN n ON n.entity = g.entity AND n.rn = g.rn + 1) n)
  SELECT entity, sha1, pack, CAST(filled - byte_length AS BIGINT) AS byte_offset, byte_length FROM g""")
def _(t):
    return G.pack_texts(by_language(t), max_bytes=20_000, max_texts=8, block=100)


@query("pack_summary", f"""{BY_LANG} SELECT entity, (rn - 1) // 64 + 1 AS pack, count(*) AS texts, CAST(sum(byte_length) AS BIGINT) AS raw_bytes
  FROM n GROUP BY 1, 2""")
def _(t):
    return G.pack_summary(G.pack_texts(by_language(t), max_bytes=1 << 40))


@query("text_of_revision", f"""WITH {DOC} SELECT entity, rev_id, CASE WHEN NOT hidden THEN sha1 END AS sha1,
    CASE WHEN hidden THEN 'hidden' ELSE 'available' END AS content_status, CASE WHEN NOT hidden THEN md5(text) END AS text_md5 FROM doc""")
def _(t):
    revisions = t.documents
    return (G.text_of(revisions.drop("text"), G.distinct_texts(revisions))
            .select("entity", "rev_id", "sha1", "content_status", F.md5("text").alias("text_md5")))


@query("texts_at", f"""WITH {DOC} SELECT entity, rev_id, ts AS valid_from, CASE WHEN hidden THEN 'hidden' ELSE 'available' END AS content_status,
    CASE WHEN NOT hidden THEN md5(text) END AS text_md5 FROM doc WHERE ts <= TIMESTAMP '{MIDDLE}'
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, rev_id DESC) = 1""")
def _(t):
    return (G.texts_at(t.documents, G.distinct_texts(t.documents), MIDDLE)
            .select("entity", "rev_id", "valid_from", "content_status", F.md5("text").alias("text_md5")))


@query("size_report", f"""{TEXTS}, r AS (SELECT count(*) AS revisions, CAST(sum(size_bytes) AS BIGINT) AS revision_bytes FROM doc),
  x AS (SELECT count(*) AS texts, CAST(sum(byte_length) AS BIGINT) AS text_bytes FROM tx)
  SELECT *, round(revision_bytes / text_bytes, 4) AS ratio FROM r, x""")
def _(t):
    return G.size_report(t.documents, G.distinct_texts(t.documents))


@query("hidden_keeps_its_place", f"""WITH {DOC} SELECT entity, rev_id, ts AS valid_from, lead(ts) OVER (PARTITION BY entity ORDER BY ts) AS valid_to,
  CASE WHEN hidden THEN 'hidden' ELSE 'available' END AS content_status FROM doc""")
def _(t):
    from twinclock.operators.timelines import build_timeline
    from twinclock.registry.app_time import shown
    docs = t.documents
    status = docs.select("entity", "rev_id", F.when(F.col("hidden"), "hidden").otherwise("available").alias("content_status"))
    return shown(build_timeline(docs)).join(status, ["entity", "rev_id"])


# What is read back from each layout; the bytes of the files have no SQL twin.
@query("layout_study", f"""{TEXTS}, s AS (SELECT entity, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM doc GROUP BY entity),
  r AS (SELECT entity, row_number() OVER (ORDER BY bytes, entity) - 1 AS rank, count(*) OVER () AS n FROM s),
  ch AS (SELECT * FROM doc WHERE entity IN (SELECT entity FROM r WHERE rank IN (floor(0.1 * n), floor(0.3 * n), floor(0.5 * n), floor(0.7 * n), floor(0.9 * n))))
  SELECT layout, (SELECT count(*) FROM ch) AS versions, CASE WHEN layout = 'digest_zstd' THEN (SELECT count(DISTINCT sha1) FROM ch WHERE sha1 IN (SELECT sha1 FROM tx))
    ELSE (SELECT count(*) FROM ch WHERE sha1 IN (SELECT sha1 FROM tx)) END AS texts FROM (VALUES ('inline'), ('inline_zstd'), ('digest_zstd')) v(layout)""")
def _(t):
    return G.layout_study(t.documents, G.distinct_texts(t.documents), [0.1, 0.3, 0.5, 0.7, 0.9]).drop("bytes")


# ---- comparison ----------------------------------------------------------------------------------

PAIRS = f"""WITH {DOC}, pr AS (SELECT rev_id AS pair_id, entity, lang, rev_id AS new_rev, sha1 AS new_sha1, hidden AS new_hidden, text AS new_text,
    lag(rev_id) OVER w AS old_rev, lag(sha1) OVER w AS old_sha1, lag(hidden) OVER w AS old_hidden, lag(text) OVER w AS old_text
    FROM doc WINDOW w AS (PARTITION BY entity, lang ORDER BY ts)), pairs AS (SELECT * FROM pr WHERE old_rev IS NOT NULL)"""


def pairs_of(t, max_bytes=None):
    """Every pair with its texts and whether they are to be compared."""
    docs = t.documents
    pairs = H.consecutive_pairs(docs, ["entity", "lang"])
    return H.with_texts(pairs, G.distinct_texts(docs)).withColumn("status", H.diff_status(max_bytes))


# Each document against itself with a sign before every line: the shortest script is known, so SQL can say all of it.
MARKED = """WITH d AS (SELECT doc_id AS pair_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
  n AS (SELECT pair_id, l, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS no FROM d)"""


def marked(t):
    new = F.concat(F.lit("§"), F.regexp_replace(F.regexp_replace("text", r"\n\z", ""), "\n", "\n§"))
    return t["documents"].filter("text <> ''").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old_text"), new.alias("new_text"))


def text_of_parts(parts):
    return F.array_join(F.transform(parts, lambda p: F.concat(F.when(p["changed"], "[").otherwise("("), p["text"])), "|")


@query("consecutive_pairs", f"{PAIRS} SELECT pair_id, entity, lang, old_rev, new_rev, old_sha1, new_sha1 FROM pairs")
def _(t):
    return H.consecutive_pairs(t.documents, ["entity", "lang"]).drop("old_hidden", "new_hidden")


@query("diff_status", f"""{PAIRS} SELECT pair_id, CASE WHEN old_hidden OR new_hidden THEN 'CONTENT_HIDDEN'
    WHEN octet_length(encode(old_text)) > 5000 OR octet_length(encode(new_text)) > 5000 THEN 'TOO_LARGE' ELSE 'OK' END AS status FROM pairs""")
def _(t):
    return pairs_of(t, max_bytes=5000).select("pair_id", "status")


# No SQL twin for the shortest edit itself: tests compare it with brute force. diff_rebuilt proves what it says.
@query("diff_lines")
def _(t):
    return H.diff_pairs(pairs_of(t))


COMPARED = f"""{PAIRS}, st AS (SELECT *, CASE WHEN old_hidden OR new_hidden THEN 'CONTENT_HIDDEN' WHEN old_text = new_text THEN 'IDENTICAL' ELSE 'OK' END AS status FROM pairs)"""


# Both texts put together again from the script, for every pair that was compared.
@query("diff_rebuilt", f"""{COMPARED} SELECT pair_id, status, CASE WHEN status = 'OK' THEN md5(regexp_replace(old_text, '\\n$', '')) END AS old_md5,
  CASE WHEN status = 'OK' THEN md5(regexp_replace(new_text, '\\n$', '')) END AS new_md5 FROM st""")
def _(t):
    def rebuilt(no):
        lines = F.array_sort(F.collect_list(F.when(F.col(no).isNotNull(), F.struct(no, "text"))))
        return F.when(F.col("status") == "OK", F.md5(F.array_join(F.transform(lines, lambda x: x["text"]), "\n")))

    return H.diff_pairs(pairs_of(t)).groupBy("pair_id", "status").agg(rebuilt("old_no").alias("old_md5"), rebuilt("new_no").alias("new_md5"))


# Line totals are the same for any correct diff, and so is old - removed = new - added.
@query("diff_totals", f"""{COMPARED}, k AS (SELECT pair_id, status,
    CASE WHEN status <> 'CONTENT_HIDDEN' THEN CASE WHEN old_text = '' THEN 0 ELSE len(string_split(regexp_replace(old_text, '\\n$', ''), chr(10))) END END AS o,
    CASE WHEN status <> 'CONTENT_HIDDEN' THEN CASE WHEN new_text = '' THEN 0 ELSE len(string_split(regexp_replace(new_text, '\\n$', ''), chr(10))) END END AS n FROM st)
  SELECT pair_id, status, o AS old_lines, n AS new_lines, n - o AS growth FROM k""")
def _(t):
    return H.diff_stats(H.diff_pairs(pairs_of(t))).select(
        "pair_id", "status", "old_lines", "new_lines", (F.col("added") - F.col("removed")).alias("growth"))


@query("diff_hunks")
def _(t):
    line = F.transform("lines", lambda x: F.concat(F.left(x["type"], F.lit(1)), F.lit(" "), x["text"]))
    return H.hunks(H.diff_pairs(pairs_of(t))).withColumn("lines", F.array_join(line, "\n"))


@query("diff_hunks_marked", f"""{MARKED} SELECT pair_id, CAST(1 AS BIGINT) AS hunk, 'OK' AS status, CAST(1 AS INTEGER) AS old_start, CAST(1 AS INTEGER) AS new_start,
  md5(array_to_string(list_concat(list_transform(l, lambda x: 'd ' || x), list_transform(l, lambda x: 'a §' || x)), chr(10))) AS lines FROM d""")
def _(t):
    line = F.transform("lines", lambda x: F.concat(F.left(x["type"], F.lit(1)), F.lit(" "), x["text"]))
    return H.hunks(H.diff_pairs(marked(t))).withColumn("lines", F.md5(F.array_join(line, "\n")))


@query("word_changes")
def _(t):
    return H.word_changes(H.diff_pairs(pairs_of(t))).select(
        "pair_id", "status", "old_no", "new_no", text_of_parts("old_parts").alias("old_parts"), text_of_parts("new_parts").alias("new_parts"))


@query("word_changes_marked", f"""{MARKED} SELECT pair_id, 'OK' AS status, no AS old_no, no AS new_no, CASE WHEN l[no] = '' THEN '' ELSE '(' || l[no] END AS old_parts,
  CASE WHEN l[no] = '' THEN '[§' ELSE '[§|(' || l[no] END AS new_parts FROM n""")
def _(t):
    return H.word_changes(H.diff_pairs(marked(t))).select(
        "pair_id", "status", "old_no", "new_no", text_of_parts("old_parts").alias("old_parts"), text_of_parts("new_parts").alias("new_parts"))


# Hunks around lines whose digest says "changed", so that there are many and they overlap; SQL can say this too.
@query("hunk_lines", """WITH l AS (SELECT doc_id AS pair_id, string_split(text, chr(10)) AS o FROM documents),
  k AS (SELECT pair_id, seq, CASE WHEN left(md5(line), 1) = '0' THEN 'del' ELSE 'same' END AS type FROM (
    SELECT pair_id, CAST(unnest(range(1, 1 + len(o))) AS INTEGER) AS seq, unnest(o) AS line FROM l)),
  c AS (SELECT pair_id, greatest(seq - 3, 1) AS a, seq + 4 AS z FROM k WHERE type <> 'same'),
  m AS (SELECT *, max(z) OVER (PARTITION BY pair_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hunk FROM m),
  h AS (SELECT pair_id, hunk, min(a) AS a, max(z) AS z FROM i GROUP BY pair_id, hunk)
  SELECT k.pair_id, seq, type, CAST(hunk AS BIGINT) AS hunk FROM k JOIN h ON h.pair_id = k.pair_id AND seq >= a AND seq < z
  UNION ALL SELECT DISTINCT pair_id, CAST(NULL AS INTEGER), NULL, CAST(NULL AS BIGINT) FROM k WHERE pair_id NOT IN (SELECT pair_id FROM c)""")
def _(t):
    lines = t["documents"].select(F.col("doc_id").alias("pair_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    changed = F.left(F.md5("line"), F.lit(1)) == "0"
    return H.hunk_lines(lines.select("pair_id", (F.col("i") + 1).alias("seq"), F.when(changed, "del").otherwise("same").alias("type")))


# Fixed value: white space, as a pattern of the SQL twin.
BLANKS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query("sentence_lines", rf"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(replace(text, chr(13), ''),
    '([.!?]){BLANKS}+([A-Z0-9"“(])', '\1' || chr(10) || '\2', 'g'), '\n+') AS l FROM documents),
  e AS (SELECT doc_id, list_filter(list_transform(l, lambda s: regexp_replace(s, '^{BLANKS}+|{BLANKS}+$', '', 'g')), lambda s: s <> '') AS l FROM d)
  SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS seq, unnest(l) AS line FROM e""")
def _(t):
    return H.sentence_lines(t["documents"], "doc_id")


@query("line_bag_delta", f"""{PAIRS}, v AS (SELECT pair_id, old_text AS o, new_text AS n FROM pairs WHERE NOT old_hidden AND NOT new_hidden),
  s AS (SELECT pair_id, unnest(string_split(regexp_replace(o, '\\n$', ''), chr(10))) AS line, -1 AS n FROM v WHERE o <> '' UNION ALL
        SELECT pair_id, unnest(string_split(regexp_replace(n, '\\n$', ''), chr(10))), 1 FROM v WHERE n <> ''),
  g AS (SELECT pair_id, line, sum(n) AS n FROM s GROUP BY pair_id, line),
  b AS (SELECT pair_id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM g GROUP BY pair_id)
  SELECT pair_id, CASE WHEN NOT old_hidden AND NOT new_hidden THEN coalesce(added, 0) END AS added,
    CASE WHEN NOT old_hidden AND NOT new_hidden THEN coalesce(removed, 0) END AS removed FROM pairs LEFT JOIN b USING (pair_id)""")
def _(t):
    return H.line_bag_delta(pairs_of(t))
