"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.llm import bpe, collocations, decontaminate, exact_dedup, language, licenses, line_dedup, mixing, periodic, signature_tree, simhash, toxicity, url_filter
from twinclock.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "piece_bpe_32k.model"
BLANK_SQL = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(x: str) -> str:
    return rf"regexp_extract_all({_lower(f'coalesce({x}, chr(32))')}, '[^\x20\x09-\x0D]+')"


def _shingles(name: str, relation: str, key: str) -> str:
    """Relation ``name`` (key, s): distinct 5-word shingles of texts of five words or more, and shorter texts whole."""
    return f"""{name}_w AS (SELECT {key}, {_words('text')} AS w FROM {relation}),
{name} AS (SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM {name}_w))"""


@query("op1_decontaminate", f"""
WITH {_shingles('i', 'benchmark', 'item_id')}, {_shingles('d', 'documents', 'doc_id')},
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*)::INTEGER AS n_shared, n_item::INTEGER AS n_item, count(*) / n_item AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item""")
def decontaminate_query(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_url_filter", """
WITH p AS (SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS k FROM pages),
q AS (SELECT page_id, CASE WHEN k = 0 THEN '' ELSE substr(u, k + 3) END AS r FROM p),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(regexp_replace(r, '^[^/?#]*', ''), '^[^?#]*') AS path FROM q),
m AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m""")
def url_filter_query(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


@query("op4_exact_dedup", rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK_SQL}', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""")
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup.decide(docs, exact_dedup.new_index(docs)).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query("op5_language_id")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def _canonical_sql(x: str) -> str:
    out = _lower(f"coalesce({x}, '')")
    for pattern, to in licenses.LINE_RULES + licenses.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return out


def _one_line_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"


_KNOWN_SQL = ", ".join("('{}', '{}', '{}')".format(*(v.replace("'", "''") for v in row)) for row in licenses.KNOWN)


@query("op6_license_scan", f"""
WITH k AS (SELECT min(license) AS license, kind, sha256({_one_line_sql(_canonical_sql('text'))}) AS h FROM (VALUES {_KNOWN_SQL}) v(license, kind, text) GROUP BY kind, h),
c AS (SELECT doc_id, {_canonical_sql('text')} AS t FROM documents),
l AS (SELECT doc_id, {_one_line_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c)),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k ON k.kind = 'notice' AND k.h = sha256(line) WHERE line <> '' GROUP BY doc_id),
w AS (SELECT doc_id, sha256({_one_line_sql('t')}) AS canonical_sha256 FROM c)
SELECT w.doc_id, canonical_sha256, k.license, notices FROM w LEFT JOIN k ON k.kind = 'text' AND k.h = canonical_sha256 LEFT JOIN f ON f.doc_id = w.doc_id""")
def license_query(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), licenses.known_table(spark))


@query("op7_mix_sources", f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * 1.0 / (SELECT count(*) FROM s) / n AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
p AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0.0 END) OVER w AS log_k FROM k WINDOW w AS (PARTITION BY source ORDER BY k)),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - log_k)) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u
  GROUP BY u.doc_id, u.text, u.lang, u.source, u.n_chars)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)""")
def mix_query(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_line_dedup", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
g AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.*, keeper IS NOT NULL AND doc_id > keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""")
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op9_simhash_dedup")
def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_token_counts")
def token_query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_counts(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def _repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a part of them repeated to the end in place of what stood there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("bigint")
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)) + 1
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    longer = F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), longer).otherwise(text)


_CRC_SQL = """list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)"""


@query("op12_periodic_runs", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NOT NULL THEN xor({_CRC_SQL}, 4294967295) END AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM e),
v AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM f),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM v WHERE n > 5)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
k AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 AS lcp FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, lcp + q AS length, min(q) AS period FROM k WHERE lcp >= q AND lcp + q >= 12 GROUP BY doc_id, start, lcp + q),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  arg_min({{'s': start, 'n': length, 'q': period}}, [-length, start, period]) AS best FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS collapsed FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM v) t ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT v.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM v LEFT JOIN b ON v.doc_id IS NOT DISTINCT FROM b.doc_id LEFT JOIN c ON v.doc_id IS NOT DISTINCT FROM c.doc_id""")
def periodic_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = periodic.periodic_runs(docs.select("doc_id", _repeated_tail(F.col("doc_id"), F.col("text")).alias("text")))
    before = lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
    best = F.try_element_at(F.array_sort("runs", lambda a, b: F.signum(before(a, b)).cast("int")), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def _phrases_sql(k: int) -> str:
    return f"""SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k}) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}"""


@query("op13_collocations", rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
f AS ({" UNION ALL ".join(map(_phrases_sql, range(1, 6)))}),
c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS x1, array_to_string(w[cut + 1:], ' ') AS x2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT lang, x.phrase, cut, x.a, l.a AS l, r.a AS r, n, 1000 * x.a::HUGEINT * n // (l.a::HUGEINT * r.a) AS score
  FROM x JOIN n USING (lang) JOIN f l USING (lang) JOIN f r USING (lang) WHERE l.phrase = x1 AND r.phrase = x2),
b AS (SELECT lang, phrase, arg_min({{'a': a, 'l': l, 'r': r, 'n': n, 's': score}}, [score, cut]) AS z FROM s GROUP BY lang, phrase),
i AS (SELECT lang, array_to_string(w[start:start + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS start FROM (SELECT *, unnest(range(2, k)) AS size FROM c)) GROUP BY ALL),
k AS (SELECT b.lang, b.phrase, z FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * z.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY z.s DESC, z.a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, z.a::BIGINT AS a, z.l::BIGINT AS l, z.r::BIGINT AS r, z.n::BIGINT AS n, z.s::BIGINT AS score FROM o WHERE rank <= {collocations.TOP}""")
def collocations_query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op11_jaccard_join", f"""
WITH RECURSIVE {_shingles('d', 'documents', 'doc_id')},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = documents.doc_id""")
def jaccard_query(spark: SparkSession, folder: str) -> DataFrame:
    return signature_tree.near_duplicates(table(spark, folder, "documents"))
