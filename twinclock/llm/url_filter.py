"""Operator 3: allow and block entries for URLs, in a trie over reversed host labels and then path segments.

An entry is ``host/path``: it fits its host and all subdomains, if the url's path starts with the entry's path (from
its first ``/``; an entry without ``/`` fits every path). Of the entries that fit, the one with the most host labels
wins, then the one with the longest path; equal entries: block wins. No entry fits: the default verdict.

Defined results: host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A null url, or one without ``://``, has both empty and gets the default verdict. A port or user name stays
part of the host as written. An empty host label fits only an equal one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinclock.llm.common import bound_batches, text_udf

#: The entries of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DEFAULT = "allow"
#: Most entries in one broadcast trie; more are matched block by block, carrying the best match along.
TRIE_RULES = 200_000
KIND = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("labels", pa.int32()), ("chars", pa.int32())])
RETURNS = "struct<host:string,path:string,rule:string,verdict:string,labels:int,chars:int>"


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


class Trie:
    """A host node is a dict from label to node; under ``ends`` a host node keeps a path trie for its entries.

    A path node is a dict from whole segment to node; ``stems`` holds entries whose last segment is a mere beginning.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            # "" is no host label of an entry's end, so it can name the path trie
            node = node.setdefault(("path",), {})
            *whole, stem = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            stems = node.setdefault(("stems",), {})
            if stems.get(stem, ("", ""))[0] != "block":
                stems[stem] = (verdict, rule)

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best, k = None, 0
        while node is not None:
            stems = node.get(("stems",))
            if stems:
                if k < len(segments):
                    here = segments[k]
                    fits = [s for s in ({here[:n] for n in range(len(here) + 1)} if len(stems) > len(here) else stems) if s in stems and here.startswith(s)]
                    if fits:
                        best = stems[max(fits, key=len)]
            node = node.get(segments[k]) if k < len(segments) - 1 else None
            k += 1
        return best

    def match(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """(verdict, entry, host labels, path length) of the entry that wins."""
        best, node, segments = None, self.root, path.split("/")
        for depth, label in enumerate(reversed(host.split(".")) if host else (), 1):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(("path",))
            found = self._path(paths, segments) if paths is not None else None
            if found:
                best = (*found, depth, len(found[1]) - len(found[1].split("/")[0]))
        return best


def _matcher(docs: DataFrame, rules: list[tuple[str, str]], default: str):
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def prepare():
        trie = Trie(shared.value)

        def one(url: bytes | None) -> dict:
            host, path = split_url(url and url.decode("utf-8", "replace"))
            verdict, rule, labels, chars = trie.match(host, path) or (default, None, 0, -1)
            return {"host": host, "path": path, "rule": rule, "verdict": verdict, "labels": labels, "chars": chars}
        return lambda urls: pa.array(map(one, urls), KIND)
    return text_udf(prepare, RETURNS)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    bound_batches(pages.sparkSession)
    out, better = pages.select("page_id", "url"), None
    for at in range(0, max(1, len(rules)), TRIE_RULES):
        new = _matcher(pages, rules[at: at + TRIE_RULES], default)(F.col("url"))
        if better is None:
            out = out.withColumn("best", new)
        else:
            out = out.withColumn("next", new)
            rank = lambda c: F.struct(f"{c}.labels", f"{c}.chars", (F.col(f"{c}.verdict") == "block").alias("block"))
            out = out.withColumn("best", F.when(F.col("next.rule").isNotNull() & (rank("next") > rank("best")), F.col("next")).otherwise(F.col("best"))).drop("next")
        better = out
    return out.select("page_id", F.col("best.host").alias("host"), F.col("best.path").alias("path"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
