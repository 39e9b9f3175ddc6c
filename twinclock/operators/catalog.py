"""Title resolution and the audited dimension it feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock import schema as X
from twinclock.functions.instants import trimmed
from twinclock.operators.systime import start_versioning
from twinclock.schema import STATUSES, USABLE_STATUSES, ntz, system_max
from twinclock.session import materialise


def _one_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key, so that a join multiplies nothing: the one with the highest ``seq`` if there is such a column,
    as in a feed that is read in order, else the greatest by value."""
    rest = [c for c in df.columns if c != key]
    order = F.struct("seq", *[c for c in rest if c != "seq"]) if "seq" in rest else F.struct(*rest)
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def normalise_titles(entries: DataFrame, normalized: DataFrame) -> DataFrame:
    """Map requested titles through (from, to); ``normalized_from`` is set where a mapping applied."""
    m = _one_per(normalized, "from").select(F.col("from").alias("requested_title"), F.col("to").alias("mapped"))
    return entries.join(m, "requested_title", "left").withColumns({
        "title": F.coalesce("mapped", "requested_title"),
        "normalized_from": F.when(F.col("mapped").isNotNull(), F.col("requested_title"))}).drop("mapped")


def follow_redirects(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, final, chain, fragment, cycle) per distinct title.

    Pointer doubling: a round joins the table of jumps with itself, so a jump of 2^k hops is known after k rounds and the
    number of rounds is the logarithm of the longest chain; there is no limit on it. A chain that comes back to a title
    it has seen ends there as a cycle. Rounds are written to the shared folder, which cuts the lineage.
    """
    hop = _one_per(redirects.select("from", "to", "tofragment", *(["seq"] if "seq" in redirects.columns else [])), "from")
    names = titles.select(F.col("title").alias("at")).union(hop.select("from")).filter("at is not null").distinct()
    nothing = F.array().cast("array<string>")
    jumps = names.join(hop.withColumnRenamed("from", "at"), "at", "left").select(
        F.col("at").alias("title"), F.coalesce("to", "at").alias("last"),
        F.when(F.col("to").isNull(), nothing).otherwise(F.array("to")).alias("chain"),
        F.when(F.col("to").isNull(), nothing).otherwise(F.array("tofragment")).alias("fragments"),
        F.col("to").isNull().alias("ended"), F.lit(False).alias("cycle"))
    jumps = _cut_at_return(jumps)
    while True:
        jumps = materialise(jumps, "redirects")
        if jumps.filter("not ended").isEmpty():
            break
        on = jumps.select(F.col("title").alias("last"), F.col("last").alias("next"), F.col("chain").alias("more"),
                          F.col("fragments").alias("more_fragments"), F.col("ended").alias("next_ended"))
        # a title that redirects nowhere ends the chain that reaches it
        goes_on = ~F.col("ended") & F.col("next").isNotNull()
        jumps = _cut_at_return(jumps.join(on, "last", "left").select(
            "title", F.when(goes_on, F.col("next")).otherwise(F.col("last")).alias("last"),
            F.when(goes_on, F.concat("chain", "more")).otherwise(F.col("chain")).alias("chain"),
            F.when(goes_on, F.concat("fragments", "more_fragments")).otherwise(F.col("fragments")).alias("fragments"),
            F.when(goes_on, F.col("next_ended")).otherwise(F.lit(True)).alias("ended"), "cycle"))
    known = F.filter("fragments", lambda f: f.isNotNull())
    return titles.select("title").distinct().join(jumps, "title").select(
        "title", F.when(~F.col("cycle"), F.col("last")).alias("final"), "chain", F.get(known, F.size(known) - 1).alias("fragment"), "cycle")


def _cut_at_return(jumps: DataFrame) -> DataFrame:
    """A chain that holds a title twice, or its own start, ends at the first return and is a cycle."""
    path = F.concat(F.array("title"), F.col("chain"))
    places = F.sequence(F.lit(1), F.size("chain"))
    back = F.array_min(F.filter(places, lambda k: F.array_position(path, F.get(path, k)) <= k))
    returns = F.when(F.size("chain") > 0, back).isNotNull()
    cycle = F.col("cycle") | returns
    return jumps.withColumns({
        "cycle": cycle, "ended": F.col("ended") | cycle,
        **{c: F.when(returns, F.slice(c, F.lit(1), back)).otherwise(F.col(c)) for c in ("chain", "fragments")}})


def classify(entries: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame, resolved_at=None) -> DataFrame:
    """Status of every entry (position, requested_title, domain), one row each.

    ``pages`` holds title, page_id, ns, missing, invalid, invalid_reason, url, is_disambiguation, and may hold lastrevid.
    ``resolved_at``: the instant the answer was given.
    """
    if "lastrevid" not in pages.columns:
        pages = pages.withColumn("lastrevid", F.lit(None).cast("bigint"))
    resolved_at = F.lit(None).cast("timestamp_ntz") if resolved_at is None else resolved_at
    named = normalise_titles(entries, normalized)
    chains = follow_redirects(named, redirects)
    page = _one_per(pages, "title").select(F.col("title").alias("final"), "page_id", "lastrevid", "ns", "missing", "invalid", "invalid_reason",
                        F.col("url").alias("page_url"), F.col("is_disambiguation").alias("dis"), F.lit(True).alias("found"))
    joined = named.join(chains, "title").join(page, "final", "left")
    redirected = ~F.col("cycle") & (F.size("chain") > 0)
    reason = (
        F.when(F.col("cycle"), X.REDIRECT_CYCLE)
        .when(F.col("found").isNull(), X.NOT_IN_RESPONSE)
        .when(F.col("invalid"), F.concat(F.lit(X.INVALID_TITLE), F.coalesce("invalid_reason", F.lit("unknown"))))
        .when(F.col("missing"), X.DOES_NOT_EXIST)
        .when(F.col("ns") != 0, F.concat(F.lit(X.OTHER_NAMESPACE), F.col("ns").cast("string")))
        .when(F.col("page_url").isNull(), X.NO_URL)
        .when(F.col("dis"), X.DISAMBIGUATION))
    status = (
        F.when(F.col("reason") == X.DOES_NOT_EXIST, "missing")
        .when(F.col("reason") == X.DISAMBIGUATION, "disambiguation")
        .when(F.col("reason").isNotNull(), "error")
        .when(F.col("is_redirect"), "redirect").otherwise("resolved"))
    exists = F.col("found") & ~F.coalesce("invalid", F.lit(False)) & ~F.coalesce("missing", F.lit(False))
    article = exists & (F.col("ns") == 0)
    return (joined.withColumn("reason", reason).withColumn("is_redirect", redirected).withColumn("status", status)
            .select("position", "requested_title", "domain", "normalized_from",
                    F.col("chain").alias("redirect_chain"), F.col("fragment").alias("redirect_fragment"),
                    "is_redirect", "status", "reason",
                    F.when(F.col("found"), F.col("final")).alias("canonical_title"),
                    F.when(exists, F.col("page_id")).alias("page_id"), F.when(article, F.col("page_url")).alias("url"),
                    F.coalesce(article & F.col("dis"), F.lit(False)).alias("is_disambiguation"),
                    F.lit(None).cast("string").alias("duplicate_of"),
                    F.when(exists, F.col("ns")).alias("namespace"), F.when(exists, F.col("lastrevid")).alias("latest_rev_id"),
                    ntz(resolved_at).alias("resolved_at")))


def usable(status: str = "status") -> Column:
    return F.col(status).isin(*USABLE_STATUSES)


def mark_duplicates(records: DataFrame) -> DataFrame:
    """A page has one owner: the entry that names it directly, else the first in curated order.

    Owners come from a map-side combined aggregate; entries then meet one owner row per page.
    """
    direct = (F.col("requested_title") == F.col("canonical_title")).cast("int")
    owners = (records.filter(usable() & F.col("page_id").isNotNull()).groupBy("page_id")
              .agg(F.min(F.struct((-direct).alias("d"), "position", F.col("requested_title").alias("owner"))).alias("o"))
              .select("page_id", F.col("o.position").alias("owner_position"), F.col("o.owner").alias("owner")))
    lost = F.coalesce(usable() & (F.col("owner_position") != F.col("position")), F.lit(False))
    return (records.join(owners, "page_id", "left").withColumn("lost", lost)
            .withColumns({
                "duplicate_resolution": F.when(F.col("lost"), F.col("status")),
                "duplicate_of": F.when(F.col("lost"), F.col("owner")).otherwise(F.col("duplicate_of")),
                "reason": F.when(F.col("lost"), F.concat(F.lit(X.SAME_PAGE), F.col("owner"), F.lit('"')))
                .otherwise(F.col("reason")),
                "status": F.when(F.col("lost"), "duplicate").otherwise(F.col("status"))})
            .drop("owner", "owner_position", "lost"))


def status_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("requested"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(usable()).alias("usable"))


def curated_problems(entries: DataFrame) -> DataFrame:
    """(position, problem, first_position) for missing titles or domains and case-insensitive repeats."""
    def blank(c):
        return F.col(c).isNull() | (trimmed(c) == "")

    key = F.lower(trimmed("title"))
    keyed = entries.withColumn("key", key)
    firsts = keyed.filter(F.col("title").isNotNull()).groupBy("key").agg(F.min("position").alias("first_position"))
    problems = F.array_compact(F.array(
        F.when(blank("title"), "missing title"), F.when(blank("domain"), "missing domain"),
        F.when(F.col("first_position") < F.col("position"), "duplicate title")))
    return (keyed.join(firsts, "key", "left").select("position", "first_position", F.explode(problems).alias("problem"))
            .withColumn("first_position", F.when(F.col("problem") == "duplicate title", F.col("first_position"))))


def upsert_plan(existing: DataFrame, desired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Desired rows with ``action`` inserted, updated or unchanged, compared null-safe field by field."""
    old = existing.select(key, F.struct(*fields).alias("old"), F.lit(True).alias("known"))
    new = F.struct(*fields)
    return (desired.select(key, *fields).join(old, key, "left")
            .withColumn("action", F.when(F.col("known").isNull(), "inserted")
                        .when(new.eqNullSafe(F.col("old")), "unchanged").otherwise("updated"))
            .drop("old", "known"))


def apply_upsert(versions: DataFrame, plan: DataFrame, key: str, at) -> DataFrame:
    """Version table after the upsert: only rows that really changed get a new version."""
    changed = plan.filter(F.col("action") != "unchanged").drop("action")
    updated = plan.filter(F.col("action") == "updated").select(key, F.lit(True).alias("ends"))
    closed = (versions.join(updated, key, "left")
              .withColumn("row_end", F.when(F.col("ends") & (F.col("row_end") == system_max()), ntz(at))
                          .otherwise(F.col("row_end"))).drop("ends"))
    return closed.unionByName(start_versioning(changed, at))


def owner_pointers(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Duplicates with the id of their owner; ``ids`` maps requested_title to article_id."""
    owner = ids.select(F.col("requested_title").alias("duplicate_of"), F.col("article_id").alias("owner_id"))
    return records.filter(F.col("status") == "duplicate").join(owner, "duplicate_of", "left")


def unknown_owners(records: DataFrame, ids: DataFrame) -> DataFrame:
    return owner_pointers(records, ids).filter(F.col("owner_id").isNull())


def assert_owners_known(records: DataFrame, ids: DataFrame) -> None:
    bad = unknown_owners(records, ids).limit(1).collect()
    if bad:
        raise ValueError(f'duplicate "{bad[0]["requested_title"]}" points to unknown owner "{bad[0]["duplicate_of"]}"')


def usable_list(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Usable entries with their event counts, in curated order."""
    counts = events.groupBy(F.col("entity").alias("article_id")).agg(F.count(F.lit(1)).alias("revisions"))
    return (articles.filter(usable()).join(counts, "article_id", "left")
            .withColumn("revisions", F.coalesce("revisions", F.lit(0))).orderBy("position"))


def curated_list(articles: DataFrame) -> DataFrame:
    """All entries with the title of the owner their duplicate pointer names, in curated order."""
    owner = articles.select(F.col("article_id").alias("duplicate_of_id"), F.col("requested_title").alias("duplicate_of"))
    return articles.drop("duplicate_of").join(owner, "duplicate_of_id", "left").orderBy("position")


def entity_card(articles: DataFrame, state: DataFrame) -> DataFrame:
    return articles.join(state.select(F.col("entity").alias("article_id"), "synced_from", "synced_through"), "article_id", "left")


def domain_list(articles: DataFrame) -> DataFrame:
    return articles.select("domain").distinct().orderBy("domain")


def in_domain(articles: DataFrame, domain: str) -> DataFrame:
    return articles.filter(F.col("domain") == domain)


def owned_page(articles: DataFrame) -> DataFrame:
    """``owned_page_id``: the page, for usable rows only."""
    return articles.withColumn("owned_page_id", F.when(usable(), F.col("page_id")))


def pages_with_two_owners(articles: DataFrame) -> DataFrame:
    return (owned_page(articles).filter(F.col("owned_page_id").isNotNull())
            .groupBy("owned_page_id").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") > 1))


def row_rule_violations(articles: DataFrame) -> DataFrame:
    """Usable rows need page, title and url; a duplicate pointer goes with status duplicate and no other."""
    incomplete = usable() & (F.col("page_id").isNull() | F.col("canonical_title").isNull() | F.col("url").isNull())
    pointer = (F.col("status") == "duplicate") != F.col("duplicate_of_id").isNotNull()
    rules = F.array_compact(F.array(F.when(incomplete, "incomplete"), F.when(pointer, "pointer")))
    return articles.select("article_id", F.explode(rules).alias("rule"))
