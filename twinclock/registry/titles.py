"""Queries on title resolution (pages) and the audited dimension (customers as articles)."""

from pyspark.sql import functions as F

from twinclock.operators import catalog as C
from twinclock.operators import systime as D
from twinclock.registry.app_time import T0
from twinclock.registry.core import query
from twinclock.registry.sql import END, EV, START, SYS_MAX

# A page address is a requested title. Query and fragment are dropped by normalisation; http becomes https, then
# m. and www. hosts, then trailing / and .html redirect; es pages redirect to their list; de pages on .net redirect
# in a circle. What the address looks like also decides what the page is.
URL = r"""u AS (SELECT page_id AS position, url AS requested_title, regexp_extract(url, '^https?://([^/]+)', 1) AS domain,
    regexp_replace(url, '[?#].*$', '') AS n FROM pages),
  h AS (SELECT *, regexp_replace(n, '^http://', 'https://') AS r1 FROM u),
  i AS (SELECT *, regexp_replace(r1, '^https://(m|www)\.', 'https://') AS r2 FROM h),
  j AS (SELECT *, regexp_replace(r2, '(/|\.html)$', '') AS r3 FROM i),
  k AS (SELECT *, regexp_replace(r3, '/es/[0-9]+$', '/es') AS r4, r3 LIKE '%.net/de/%' AS circle FROM j),
  pg AS (SELECT r4 AS title, min(position) AS page_id, CASE WHEN r4 LIKE '%.org/fr/%' THEN 1 ELSE 0 END AS ns,
    r4 LIKE '%spam-farm%' OR r4 LIKE '%cheap-pills%' AS missing, r4 LIKE '%//blog.thern%' AS invalid,
    CASE WHEN r4 NOT LIKE '%.com/de/%' THEN r4 END AS url, regexp_matches(r4, '/en/[0-9]{1,2}$') AS dis
    FROM k WHERE NOT circle AND r4 NOT LIKE '%.org/es%' GROUP BY r4)"""

RECORDS = f"""{URL}, c AS (SELECT k.*, pg.title, pg.page_id AS pid, ns, missing, invalid, pg.url AS purl, dis,
    list_filter([CASE WHEN r1 <> n THEN r1 END, CASE WHEN r2 <> r1 THEN r2 END, CASE WHEN r3 <> r2 THEN r3 END, CASE WHEN r4 <> r3 THEN r4 END,
                 CASE WHEN circle THEN replace(r3, '/de/', '/DE/') END, CASE WHEN circle THEN r3 END], lambda x: x IS NOT NULL) AS chain,
    CASE WHEN r4 <> r3 THEN 'list' WHEN r3 <> r2 THEN 'body' END AS fragment
    FROM k LEFT JOIN pg ON pg.title = k.r4 AND NOT circle),
  s AS (SELECT *, NOT circle AND len(chain) > 0 AS is_redirect,
    CASE WHEN circle THEN 'redirect_cycle' WHEN title IS NULL THEN 'page_not_in_response' WHEN invalid THEN 'invalid_title: bad host'
         WHEN missing THEN 'page_does_not_exist' WHEN ns <> 0 THEN 'not_an_article_namespace_' || ns WHEN purl IS NULL THEN 'api_returned_no_url'
         WHEN dis THEN 'page_is_a_disambiguation_page' END AS reason FROM c),
  rec AS (SELECT position, requested_title, domain, CASE WHEN n <> requested_title THEN requested_title END AS normalized_from,
    array_to_string(chain, ' > ') AS chain, fragment AS redirect_fragment, is_redirect, reason,
    CASE WHEN reason = 'page_does_not_exist' THEN 'missing' WHEN reason = 'page_is_a_disambiguation_page' THEN 'disambiguation'
         WHEN reason IS NOT NULL THEN 'error' WHEN is_redirect THEN 'redirect' ELSE 'resolved' END AS status,
    title AS canonical_title, CASE WHEN title IS NOT NULL AND NOT invalid AND NOT missing THEN pid END AS page_id,
    CASE WHEN title IS NOT NULL AND NOT invalid AND NOT missing AND ns = 0 THEN purl END AS url,
    coalesce(title IS NOT NULL AND NOT invalid AND NOT missing AND ns = 0 AND dis, false) AS is_disambiguation FROM s),
  ow AS (SELECT page_id, requested_title AS owner, position AS owner_position FROM rec WHERE status IN ('resolved', 'redirect')
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY requested_title = canonical_title DESC, position) = 1),
  dup AS (SELECT rec.*, owner, coalesce(status IN ('resolved', 'redirect') AND owner_position <> position, false) AS lost FROM rec LEFT JOIN ow USING (page_id)),
  fin AS (SELECT position, requested_title, domain, canonical_title, page_id, url, is_redirect, is_disambiguation, redirect_fragment,
    CASE WHEN lost THEN 'duplicate' ELSE status END AS status, CASE WHEN lost THEN owner END AS duplicate_of,
    CASE WHEN lost THEN status END AS duplicate_resolution,
    CASE WHEN lost THEN 'resolves to the same page as "' || owner || '"' ELSE reason END AS reason FROM dup)"""


def feed(t):
    """(entries, normalized, redirects, pages) as the title service would answer for the page addresses."""
    k = (t["pages"].select(F.col("page_id").alias("position"), F.col("url").alias("requested_title"),
                           F.regexp_extract("url", "^https?://([^/]+)", 1).alias("domain"),
                           F.regexp_replace("url", "[?#].*$", "").alias("n"))
         .withColumn("r1", F.regexp_replace("n", "^http://", "https://"))
         .withColumn("r2", F.regexp_replace("r1", r"^https://(m|www)\.", "https://"))
         .withColumn("r3", F.regexp_replace("r2", r"(/|\.html)$", ""))
         .withColumn("r4", F.regexp_replace("r3", "/es/[0-9]+$", "/es"))
         .withColumn("circle", F.col("r3").like("%.net/de/%")))
    entries = k.select("position", "requested_title", "domain")
    normalized = k.filter("n <> requested_title").select(F.col("requested_title").alias("from"), F.col("n").alias("to"))
    capital = F.replace("r3", F.lit("/de/"), F.lit("/DE/"))

    def hop(a, b, fragment=None, when=F.lit(True)):
        return F.when(when & (a != b), F.struct(a.alias("from"), b.alias("to"), F.lit(fragment).cast("string").alias("tofragment")))

    c = F.col
    redirects = k.select(F.explode(F.array_compact(F.array(
        hop(c("n"), c("r1")), hop(c("r1"), c("r2")), hop(c("r2"), c("r3"), "body"), hop(c("r3"), c("r4"), "list"),
        hop(c("r3"), capital, when=c("circle")), hop(capital, c("r3"), when=c("circle"))))).alias("r")).select("r.*").distinct()
    title = c("title")
    pages = (k.filter("NOT circle AND r4 NOT LIKE '%.org/es%'").groupBy(c("r4").alias("title")).agg(F.min("position").alias("page_id"))
             .select("title", "page_id", F.when(title.like("%.org/fr/%"), 1).otherwise(0).alias("ns"),
                     (title.like("%spam-farm%") | title.like("%cheap-pills%")).alias("missing"),
                     title.like("%//blog.thern%").alias("invalid"), F.lit("bad host").alias("invalid_reason"),
                     F.when(~title.like("%.com/de/%"), title).alias("url"), title.rlike("/en/[0-9]{1,2}$").alias("is_disambiguation")))
    return entries, normalized, redirects, pages


@query("normalise_titles", f"WITH {URL} SELECT position, n AS title, CASE WHEN n <> requested_title THEN requested_title END AS normalized_from FROM u")
def _(t):
    entries, normalized, _, _ = feed(t)
    return C.normalise_titles(entries, normalized).select("position", "title", "normalized_from")


@query("follow_redirects", f"""WITH {RECORDS} SELECT DISTINCT n AS title, CASE WHEN NOT circle THEN r4 END AS final,
  array_to_string(chain, ' > ') AS chain, fragment, circle AS cycle FROM c""")
def _(t):
    entries, normalized, redirects, _ = feed(t)
    out = C.follow_redirects(C.normalise_titles(entries, normalized), redirects)
    return out.withColumn("chain", F.array_join("chain", " > "))


@query("classify_titles", f"""WITH {RECORDS} SELECT rec.*, CASE WHEN rec.page_id IS NOT NULL THEN CAST(ns AS INTEGER) END AS namespace,
  CASE WHEN rec.page_id IS NOT NULL THEN pg.page_id * 10 END AS latest_rev_id, TIMESTAMP '{T0}' AS resolved_at FROM rec LEFT JOIN pg ON pg.title = canonical_title""")
def _(t):
    entries, normalized, redirects, pages = feed(t)
    pages = pages.withColumn("lastrevid", F.col("page_id") * 10)
    return (C.classify(entries, normalized, redirects, pages, T0).withColumn("chain", F.array_join("redirect_chain", " > "))
            .drop("redirect_chain", "duplicate_of"))


@query("mark_duplicates", f"WITH {RECORDS} SELECT * FROM fin")
def _(t):
    return C.mark_duplicates(C.classify(*feed(t))).drop("redirect_chain", "normalized_from", "namespace", "latest_rev_id", "resolved_at")


@query("status_summary", f"""WITH {RECORDS} SELECT count(*) AS requested,
  {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('resolved', 'redirect', 'missing', 'disambiguation', 'duplicate', 'error'))},
  count(*) FILTER (WHERE status IN ('resolved', 'redirect')) AS usable FROM fin""")
def _(t):
    return C.status_summary(C.mark_duplicates(C.classify(*feed(t))))


# A curated list with gaps and repeats: host names as titles, http pages without a domain.
@query("curated_problems", """WITH e AS (SELECT page_id AS position, CASE WHEN url LIKE '%/fr/%' THEN ' ' ELSE upper(regexp_extract(url, '//([^/]+)', 1)) || ' ' END AS title,
    CASE WHEN url LIKE 'https%' THEN 'd' END AS domain FROM pages),
  f AS (SELECT *, min(position) OVER (PARTITION BY lower(trim(title))) AS first FROM e)
  SELECT position, NULL AS first_position, 'missing title' AS problem FROM f WHERE trim(title) = ''
  UNION ALL SELECT position, NULL, 'missing domain' FROM f WHERE domain IS NULL
  UNION ALL SELECT position, first, 'duplicate title' FROM f WHERE first < position""")
def _(t):
    entries = t["pages"].select(
        F.col("page_id").alias("position"),
        F.when(F.col("url").like("%/fr/%"), " ").otherwise(F.concat(F.upper(F.regexp_extract("url", "//([^/]+)", 1)), F.lit(" "))).alias("title"),
        F.when(F.col("url").like("https%"), "d").alias("domain"))
    return C.curated_problems(entries)


# ---- customers as articles -----------------------------------------------------------------------

ART = """own AS (SELECT c_nationkey AS nk, min(c_custkey) AS owner FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
  art AS (SELECT c_custkey AS article_id, c_custkey AS position, c_name AS requested_title, r_name AS domain,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'resolved' WHEN 'FURNITURE' THEN 'redirect' WHEN 'MACHINERY' THEN 'duplicate'
         WHEN 'HOUSEHOLD' THEN 'missing' ELSE 'disambiguation' END AS status,
    CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_custkey WHEN c_mktsegment = 'MACHINERY' THEN owner END AS page_id,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_name END AS canonical_title,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_acctbal > -500 THEN '/page/' || c_custkey END AS url,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN owner END AS duplicate_of_id
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN own ON nk = c_nationkey)"""
COLUMNS = "article_id, position, requested_title, domain, status, page_id, canonical_title, url, duplicate_of_id"


def articles(t):
    cu = t["customer"]
    own = (cu.filter("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("c_custkey").alias("owner")))
    names = t["nation"].join(t["region"], F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("domain"))
    seg = F.col("c_mktsegment")
    return (cu.join(names, "c_nationkey").join(own, "c_nationkey", "left").select(
        F.col("c_custkey").alias("article_id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("requested_title"), "domain",
        F.when(seg == "BUILDING", "resolved").when(seg == "FURNITURE", "redirect").when(seg == "MACHINERY", "duplicate")
        .when(seg == "HOUSEHOLD", "missing").otherwise("disambiguation").alias("status"),
        F.when(seg.isin("BUILDING", "FURNITURE"), F.col("c_custkey")).when(seg == "MACHINERY", F.col("owner")).alias("page_id"),
        F.when(seg != "HOUSEHOLD", F.col("c_name")).alias("canonical_title"),
        F.when((seg != "HOUSEHOLD") & (F.col("c_acctbal") > -500), F.concat(F.lit("/page/"), F.col("c_custkey").cast("string"))).alias("url"),
        F.when(seg == "MACHINERY", F.col("owner")).alias("duplicate_of_id")))


FIELDS = ["domain", "status", "page_id", "canonical_title", "url", "duplicate_of_id"]


def refreshed(t):
    """The catalogue as resolved later: AFRICA was renamed, missing titles turned up, ASIA is new."""
    arts = articles(t)
    existing = arts.filter("domain <> 'ASIA'")
    desired = arts.withColumns({
        "canonical_title": F.when(F.col("domain") == "AFRICA", F.upper("canonical_title")).otherwise(F.col("canonical_title")),
        "status": F.when((F.col("status") == "missing") & (F.col("domain") == "EUROPE"), "redirect").otherwise(F.col("status"))})
    return existing, C.upsert_plan(existing, desired, "requested_title", FIELDS)


UPSERT = f"""WITH {ART}, want AS (SELECT requested_title, domain, CASE WHEN status = 'missing' AND domain = 'EUROPE' THEN 'redirect' ELSE status END AS status, page_id,
    CASE WHEN domain = 'AFRICA' THEN upper(canonical_title) ELSE canonical_title END AS canonical_title, url, duplicate_of_id, canonical_title AS was, status AS st FROM art),
  pl AS (SELECT requested_title, domain, status, page_id, canonical_title, url, duplicate_of_id, CASE WHEN domain = 'ASIA' THEN 'inserted'
    WHEN canonical_title IS DISTINCT FROM was OR status <> st THEN 'updated' ELSE 'unchanged' END AS action FROM want)"""


@query("upsert_plan", f"{UPSERT} SELECT * FROM pl")
def _(t):
    return refreshed(t)[1]


@query("upsert_counts", f"{UPSERT} SELECT action, count(*) AS n FROM pl GROUP BY action")
def _(t):
    return refreshed(t)[1].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("apply_upsert", f"""{UPSERT}, o AS (SELECT requested_title, domain, status, page_id, canonical_title, url, duplicate_of_id FROM art WHERE domain <> 'ASIA')
  SELECT o.*, TIMESTAMP '{START}' AS row_start, CASE WHEN pl.action = 'updated' THEN TIMESTAMP '{T0}' ELSE {SYS_MAX} END AS row_end FROM o JOIN pl USING (requested_title)
  UNION ALL SELECT pl.* EXCLUDE (action), TIMESTAMP '{T0}', {SYS_MAX} FROM pl WHERE action <> 'unchanged'""")
def _(t):
    existing, plan = refreshed(t)
    versions = D.start_versioning(existing.select("requested_title", *FIELDS), START)
    return C.apply_upsert(versions, plan, "requested_title", T0)


@query("owner_pointers", f"""WITH {ART} SELECT a.requested_title, o.requested_title AS duplicate_of, o.article_id AS owner_id
  FROM art a LEFT JOIN art o ON o.article_id = a.duplicate_of_id WHERE a.status = 'duplicate'""")
def _(t):
    arts = articles(t)
    records = C.curated_list(arts).select("requested_title", "status", "duplicate_of")
    return C.owner_pointers(records, arts).select("requested_title", "duplicate_of", "owner_id")


# The owners in two regions are not in the id table; a duplicate that names no owner is an error as well.
@query("unknown_owners", f"""WITH {ART} SELECT a.requested_title, o.requested_title AS duplicate_of FROM art a LEFT JOIN art o ON o.article_id = a.duplicate_of_id
  WHERE a.status = 'duplicate' AND (o.article_id IS NULL OR o.domain IN ('ASIA', 'EUROPE'))""")
def _(t):
    arts = articles(t)
    records = C.curated_list(arts).select("requested_title", "status", "duplicate_of")
    return C.unknown_owners(records, arts.filter(~F.col("domain").isin("ASIA", "EUROPE"))).select("requested_title", "duplicate_of")


@query("usable_list", f"""WITH {ART}, {EV}, n AS (SELECT entity, count(*) AS c FROM ev GROUP BY entity)
  SELECT {COLUMNS}, coalesce(c, 0) AS revisions FROM art LEFT JOIN n ON entity = article_id WHERE status IN ('resolved', 'redirect')""")
def _(t):
    return C.usable_list(articles(t), t.orders)


@query("curated_list", f"""WITH {ART} SELECT {', '.join('a.' + c for c in COLUMNS.split(', '))}, o.requested_title AS duplicate_of
  FROM art a LEFT JOIN art o ON o.article_id = a.duplicate_of_id""")
def _(t):
    return C.curated_list(articles(t))


@query("entity_card", f"""WITH {ART}, {EV}, s AS (SELECT entity, min(ts) AS synced_from, max(ts) AS synced_through FROM ev GROUP BY entity)
  SELECT {COLUMNS}, synced_from, synced_through FROM art LEFT JOIN s ON entity = article_id""")
def _(t):
    state = t.orders.groupBy("entity").agg(F.min("ts").alias("synced_from"), F.max("ts").alias("synced_through"))
    return C.entity_card(articles(t), state)


@query("domain_list", f"WITH {ART} SELECT DISTINCT domain FROM art")
def _(t):
    return C.domain_list(articles(t))


@query("in_domain", f"WITH {ART} SELECT {COLUMNS} FROM art WHERE domain = 'EUROPE'")
def _(t):
    return C.in_domain(articles(t), "EUROPE")


# Promoting the duplicates to usable rows makes pages with two owners.
@query("pages_with_two_owners", f"""WITH {ART} SELECT page_id AS owned_page_id, count(*) AS owners FROM art
  WHERE status IN ('resolved', 'redirect', 'duplicate') AND page_id IS NOT NULL GROUP BY page_id HAVING count(*) > 1""")
def _(t):
    promoted = articles(t).withColumn("status", F.when(F.col("status") == "duplicate", "redirect").otherwise(F.col("status")))
    return C.pages_with_two_owners(promoted)


@query("row_rule_violations", f"""WITH {ART}, b AS (SELECT *, CASE WHEN domain = 'ASIA' THEN NULL ELSE duplicate_of_id END AS ptr FROM art)
  SELECT article_id, 'incomplete' AS rule FROM b WHERE status IN ('resolved', 'redirect') AND (page_id IS NULL OR canonical_title IS NULL OR url IS NULL)
  UNION ALL SELECT article_id, 'pointer' FROM b WHERE (status = 'duplicate') <> (ptr IS NOT NULL)""")
def _(t):
    broken = articles(t).withColumn("duplicate_of_id", F.when(F.col("domain") != "ASIA", F.col("duplicate_of_id")))
    return C.row_rule_violations(broken)
